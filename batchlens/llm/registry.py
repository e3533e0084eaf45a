"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchlens.llm.ann import op8_nearest_neighbours
from batchlens.llm.caps import ORACLE_SQL as CAPS_SQL
from batchlens.llm.caps import op13_spherical_caps
from batchlens.llm.chat import op9_chat_formatting
from batchlens.llm.decontam import op4_decontamination
from batchlens.llm.fim import ORACLE_SQL as FIM_SQL
from batchlens.llm.fim import op12_fill_in_middle
from batchlens.llm.jaccard_join import op6_jaccard_join
from batchlens.llm.licenses import op7_license_scans
from batchlens.llm.merkle import ORACLE_SQL as MERKLE_SQL
from batchlens.llm.merkle import op11_merkle_manifest
from batchlens.llm.ngram_lm import op1_ngram_lm
from batchlens.llm.packing import op10_best_fit_packing
from batchlens.llm.quality import op3_quality_classifier
from batchlens.llm.rans import op2_rans_tokens
from batchlens.llm.secrets import op5_secret_scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_lm": op1_ngram_lm,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scans": op5_secret_scans,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scans": op7_license_scans,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spherical_caps": op13_spherical_caps,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_fill_in_middle": FIM_SQL,
    "op13_spherical_caps": CAPS_SQL,
    "op6_jaccard_join": f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
c as (select min(doc_id) as class, len(sh) as n, list_sort(sh) as sh from s where len(sh) > 0 group by all),
m as (select s.doc_id, c.class from s join c on c.sh = list_sort(s.sh)),
t as (select class, n, unnest(sh) as g from c),
l as (select a.class as x, b.class as y from t a join t b on a.g = b.g and a.class < b.class and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.class, b.class, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select x, y from l union all select y, x from l),
r(class, reach) as (select class, class from c where class in (select x from e) union select r.class, e.y from r join e on e.x = r.reach),
k as (select class, min(reach) as low from r group by class)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, coalesce(k.low, m.class, s.doc_id) as component_id from s left join m on m.doc_id = s.doc_id left join k on k.class = m.class
""",
    # Turns that take the light escapes, as all turns do whose light escapes can be read back.
    "op9_chat_formatting": """
with v as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(role) + length(regexp_replace(text, '(\\\\*)(</?s>|\\[/?[A-Za-z_]*\\])', '\\1\\1\\\\\\2', 'g'))) as bigint) as formatted_chars
from v group by conv_id
""",
}
