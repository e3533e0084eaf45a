"""Groups of layouts against brute force."""

import random

from batchlens.sources.corpus import group_fingerprints, layout_groups, layout_sets

WORDS = "conc cps rsd sample type level mass element unit dilution vial method run date time comment note blank".split()


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    bases = [rng.sample(WORDS, 11) for _ in range(4)]
    files = {}
    for i in range(120):
        names = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            names[rng.randrange(len(names))] = rng.choice([*WORDS, f"Northside Well {i}", f"Ag {i}"])
        files[i] = [n.upper() if rng.random() < 0.2 else n for n in names]
    files |= {500: ["", " "], 501: [None]}
    rows = [(f, c, n) for f, names in files.items() for c, n in enumerate(names)]
    headers = spark.createDataFrame(rows, "file int, col int, name string").repartition(5)
    sets = {r["file"]: (r["layout"], frozenset(r["names"])) for r in layout_sets(headers).collect()}
    assert all("northside" not in n for _, names in sets.values() for n in names) and sets[500] == sets[501] and not sets[500][1]
    layouts = dict(sets.values())
    root = {x: x for x in layouts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in layouts:
        for b in layouts:
            if a < b and layouts[a] and len(layouts[a] & layouts[b]) >= 0.8 * len(layouts[a] | layouts[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = layout_groups(headers)
    got = {r["file"]: (r["layout"], r["group"]) for r in groups.collect()}
    assert got == {f: (layout, find(layout)) for f, (layout, _) in sets.items()} and 4 <= len({g for _, g in got.values()}) < len(layouts)
    prints = {r["group"]: r for r in group_fingerprints(headers, groups).collect()}
    assert sum(r["n_files"] for r in prints.values()) == 122 and set(prints) == {g for _, g in got.values()}
    for g, r in prints.items():
        own = [sets[f][1] for f in sets if got[f][1] == g]
        assert r["names"] == sorted(n for n in set().union(*own) if sum(n in s for s in own) >= 0.5 * len(own)) and r["n_layouts"] == len({sets[f][0] for f in sets if got[f][1] == g})
    assert layout_groups(headers.limit(0)).count() == 0
