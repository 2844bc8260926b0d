import random

from roadgrain.llm.leak import Passages, alike, carried, find_leaks, tiles, words

P = "Whoever floats 13 jars must also carry 29 hollow rings near the tilted pier while Sekvis lent an orchard manager 21 amber blocks and the ferry cook counts what remained before dusk"
OTHER = "The dealer cleaned my antenna lead again and charged two hundred crowns but the odometer still drifts whenever the radio is on near the weighbridge in heavy rain"
I = "item_id long, item_kind string, stem string, passage string"


def test_plain_words():
    assert words("A <b>big</b> [i]cat&nbsp;&amp;</i> dоg​s fl­ew_") == ["a", "big", "cat", "dogs", "flew"]
    assert words("hard-\n> ened") == ["hardened"] and words(None) == [] and words("...") == []


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        p, t = ([rng.choice("abcd") for _ in range(n)] for n in (14, 30))
        got = tiles(p, t, 2)
        mp, mt, want = set(), set(), 0
        while True:  # the definition: mark the longest unmarked common run
            best = (1, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and i + k not in mp and j + k not in mt:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < 2:
                break
            mp |= set(range(i, i + k))
            mt |= set(range(j, j + k))
            want += k
        assert all(p[i : i + k] == t[j : j + k] for i, j, k in got)
        assert len({x for i, _, k in got for x in range(i, i + k)}) == sum(k for *_, k in got)
        assert abs(sum(k for *_, k in got) - want) <= 3 and (not got or max(k for *_, k in got) >= 2)


def test_alike_and_carried():
    assert alike("kettles", "kettkes") and alike("cook", "coook") and alike("form", "from") and not alike("13", "14") and not alike("cat", "cut")
    p = words(P)
    assert carried(p, words(OTHER) + p + words(OTHER)) == 1.0
    assert carried(p, p[::-1]) < 0.3
    spread = [w for x in p for w in [x, *["pad"] * 6]]
    assert carried(p, spread) < 0.5


def test_find(spark):
    w = P.split()
    half = " ".join(w[: len(w) // 2])
    most = " ".join(w[: int(len(w) * 0.75)])
    docs = [
        (1, OTHER + "\n" + P + "\n" + OTHER), (2, OTHER + half), (3, OTHER + " " + most + " " + OTHER), (4, P.upper().replace("JARS", "<b>JARS</b>").replace(" ", "&nbsp; ")), (5, P.replace("a", "а").replace("o", "о")),
        (6, "\n> ".join(P.split(" "))), (7, " uh ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4))), (8, None), (9, ""), (10, OTHER * 300), (11, "Answer in one sentence. " + OTHER), (12, P), (12, P), (13, OTHER * 200 + P),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as passage")
    items = spark.createDataFrame([(1, "a", "Answer in one sentence.", P), (1, "a", "Answer in one sentence.", P), (2, "a", None, None), (3, "a", None, "too short"), (4, "a", None, "")], I)
    for block in (1, 2000):
        got = {(r.doc_id, r.item_id) for r in find_leaks(d, items, block=block).collect()}
        assert got == {(k, 1) for k in (1, 3, 4, 5, 6, 7, 12, 13)}
    assert find_leaks(d.limit(0), items).count() == 0 and find_leaks(d, items.limit(0)).count() == 0


def test_slips_in_all_longer_words(spark):
    slips = " ".join(x + x[-1] if len(x) > 3 else x for x in P.split())  # no exact triple is left
    d = spark.createDataFrame([(1, OTHER + " " + slips + " " + OTHER), (2, OTHER + OTHER)], "doc_id long, text string")
    got = find_leaks(d, spark.createDataFrame([(1, "a", None, P)], I)).collect()
    assert [(r.doc_id, r.item_id, r.carried) for r in got] == [(1, 1, 1.0)]


def test_reordered_passages_are_covered_but_not_carried(spark):
    w = P.split()
    q = len(w) // 4
    quarters = [w[i * q : (i + 1) * q] if i < 3 else w[3 * q :] for i in range(4)]
    mixed = " ".join(x for i in (3, 1, 2, 0) for x in quarters[i])
    d = spark.createDataFrame([(1, OTHER + " " + mixed + " " + OTHER), (2, P), (3, OTHER)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(d, spark.createDataFrame([(1, "a", None, P)], I)).collect()}
    assert set(got) == {1, 2} and got[1].tile_cover == 1.0 and got[1].carried < 0.6 and got[2].carried == 1.0


def brute(passage, text, share):
    """Both measures by their definitions, over every pair: no search for candidates."""
    p, w = words(passage), words(text)
    if not w:
        return None
    own = set(p)
    same = lambda a, b: a == b if b in own else alike(a, b)  # noqa: E731  a word counts as itself before any other
    reach, best = 2 * len(p) + 1, 0
    for s in range(0, len(w), max(1, len(p) // 8)):
        t = w[s : s + reach]
        row = [0] * (len(p) + 1)
        for x in t:
            old = row[:]
            for i, y in enumerate(p):
                row[i + 1] = max(old[i + 1], row[i], old[i] + same(y, x))
        best = max(best, row[-1])
    return best / len(p)


def test_finding_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [w for w in set(words(P) + words(OTHER)) if len(w) > 2] + [f"word{i}x" for i in range(60)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 30))) for _ in range(12)]
    docs = []
    for n in range(150):
        w = rng.choice(passages).split()
        keep = rng.uniform(0.3, 1.0)
        a = rng.randint(0, int(len(w) * (1 - keep)))
        part = [x if rng.random() < 0.8 or len(x) < 5 else x[:2] + "q" + x[3:] for x in w[a : a + int(len(w) * keep) + 1]]
        if n % 5 == 0:
            rng.shuffle(part)
        pad = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        docs.append((n, " ".join(pad() + part + pad())))
    items = [(k, "a", None, p) for k, p in enumerate(passages)]
    got = {(r.doc_id, r.item_id): r for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, I)).collect()}
    found = {k for k, r in got.items() if r.carried >= 0.6}
    want = {(d, k): brute(p, t, 0.6) for d, t in docs for k, p in enumerate(passages)}
    # The windows of the two step differently, so pairs just at the share may differ.
    assert {k for k, c in want.items() if c >= 0.65} <= found <= {k for k, c in want.items() if c >= 0.55}
    assert len(found) > 40
    for (d, k), r in got.items():
        assert max(r.tile_cover, r.carried) >= 0.6


def test_scripts_without_blanks_and_long_tags():
    assert words("私はカメラ") == list("私はカメラ") and words("<a href='" + "x" * 500 + "'>b</a>") == ["b"]
    p = Passages([(1, words("東京都の図書館で本を借りた"))])
    assert [m[0] for m in p.matches("昨日、東京都の図書館で本を借りたよ", 0.6)] == [1]
