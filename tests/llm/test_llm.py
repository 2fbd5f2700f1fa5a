"""Training-data operators against brute force on small input."""

import itertools
import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lockstep.llm import cooccurrence, heavy_hitters, leak_index, mixing, queries, setjoin, spam

# ---- most frequent items


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=80), max_size=6), st.integers(1, 8))
def test_summaries_stay_within_their_bound(parts, k):
    whole, merged, error = Counter(), Counter(), 0
    for part in parts:
        own = Counter(part)
        whole.update(part)
        error += heavy_hitters.reduce_counters(own, k)
        merged.update(own)
        error += heavy_hitters.reduce_counters(merged, k)
    n = sum(whole.values())
    assert error * (k + 1) <= n and len(merged) <= k
    assert all(merged[i] <= whole[i] <= merged[i] + error for i in whole)


@pytest.mark.parametrize("fan_in,tasks", [(2, 16), (32, 4)])
def test_frequent_items(spark, fan_in, tasks):
    rng = random.Random(5)
    items = ["hot"] * 900 + ["tie1"] * 40 + ["tie2"] * 40 + [f"rare{i}" for i in range(3000)]
    rng.shuffle(items)
    rows = [("f", i, "x") for i in items] + [("g", "one", "x")] + [("f", None, "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, "field string, item string, count string").repartition(tasks)
    got = {(r.field, r.item): r for r in heavy_hitters.misra_gries(df, k=50, fan_in=fan_in).collect()}
    truth = Counter((r[0], r[1]) for r in rows if None not in r)
    for key, r in got.items():
        assert r["count"] <= truth[key] <= r.upper and r.upper - r["count"] <= r.n / 51
    assert got["f", "hot"].n == len(items) and ("g", "one") in got
    found = {(r.field, r.item, r.exact) for r in heavy_hitters.frequent_items(df.select("field", "item"), support=0.01, k=150, fan_in=fan_in).collect()}
    assert found == {("f", "hot", 900), ("f", "tie1", 40), ("f", "tie2", 40), ("g", "one", 1)}
    assert heavy_hitters.frequent_items(df.select("field", "item").limit(0)).count() == 0
    with pytest.raises(ValueError):
        heavy_hitters.frequent_items(df, support=0.01, k=100)


# ---- items that appear together


def pairs_by_hand(rows, window, least, lift):
    first = {}
    for account, item, t in rows:
        if None not in (account, item, t):
            first[account, item] = min(t, first.get((account, item), t))
    own = defaultdict(dict)
    for (account, item), t in first.items():
        own[account][item] = t
    n, out = len({i for _, i in first}), {}
    for a, b in itertools.combinations(sorted(own), 2):
        n_ab = sum(abs(own[a][i] - own[b][i]) <= window for i in own[a].keys() & own[b].keys())
        if n_ab >= least and n_ab * n >= lift * len(own[a]) * len(own[b]):
            out[a, b] = (n_ab, len(own[a]), len(own[b]), n)
    return out


@pytest.mark.parametrize("seed,part,lift", [(1, 256, 2.0), (2, 3, 1.0), (3, 2, 0.0), (4, 1, 1.0)])
def test_cooccurrence_against_brute_force(spark, seed, part, lift):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(25)}", "hot" if rng.random() < 0.35 else f"i{int(rng.paretovariate(0.7)) % 80}", rng.randrange(0, 300)) for _ in range(700)]
    rows += [(f"bot{b}", f"i{i}", 1000 * i + rng.randrange(70)) for i in range(6) for b in range(4)]
    rows += [(None, "i1", 3), ("u1", None, 3), ("u1", "i1", None), *rows[:30]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "account string, item string, t long, weight string")
    got = cooccurrence.cooccurring_pairs(df, 60, 3, lift, part).collect()
    assert {(r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == pairs_by_hand(rows, 60, 3, lift)
    assert got and len({(r.a, r.b) for r in got}) == len(got)


def test_cooccurrence_of_nothing(spark):
    empty = spark.createDataFrame([], "account string, item string, t long")
    assert cooccurrence.cooccurring_pairs(empty, 60).count() == 0


def test_collapsed_baskets_weigh_the_same(spark):
    rows = [(a, f"i{i}", 0) for i in range(5) for a in "abc"]
    df = spark.createDataFrame(rows, "account string, item string, t long")
    got = {(r.a, r.b): r.weight for r in cooccurrence.basket_pairs(df, 60, 100).collect()}
    assert got == {("a", "b"): 5, ("a", "c"): 5, ("b", "c"): 5}
    seated = df.selectExpr("account", "item", "t as cell", "0L as part", "1L as parts")
    assert [tuple(r) for r in cooccurrence.collapsed_baskets(seated).collect()] == [(["a", "b", "c"], [], 5)]


@pytest.mark.parametrize("part", [1, 4, 1000])
def test_weights_are_the_counts(spark, part):
    rng = random.Random(part)
    events = {(f"u{rng.randrange(40)}", f"i{rng.randrange(3)}"): rng.randrange(200) for _ in range(300)}
    df = spark.createDataFrame([(*k, t) for k, t in events.items()], "account string, item string, t long")
    want = Counter()
    for ((a, i), t), ((b, j), u) in itertools.combinations(sorted(events.items()), 2):
        want[a, b] += i == j and a != b and abs(t - u) <= 60
    got = {(r.a, r.b): r.weight for r in cooccurrence.basket_pairs(df, 60, part).collect()}
    assert got == {k: n for k, n in want.items() if n} and got


# ---- similar sets


def random_sets(seed, n=60):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        sets[f"s{i}"] = {f"hot{rng.randrange(4)}" for _ in range(3)} | {f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 14))}
    for i in range(n // 2):
        base = set(sets[f"s{rng.randrange(n)}"])
        for _ in range(rng.randrange(4)):
            base.discard(rng.choice(sorted(base))) if rng.random() < 0.5 and len(base) > 1 else base.add(f"v{rng.randrange(400)}")
        sets[f"t{i}"] = base
    return sets


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_signatures_of_similar_sets_meet(seed, t):
    rng = random.Random(seed)
    rule = setjoin.Pigeonhole(t, 1)
    common = [rng.getrandbits(64) & ~0xFF00 if rng.random() < 0.3 else rng.getrandbits(64) for _ in range(rng.randrange(1, 25))]
    r, s = set(common), set(common)
    for side in (r, s):
        for _ in range(rng.randrange(4)):
            side.add(rng.getrandbits(64))
    private_r, private_s = rng.randrange(3), rng.randrange(3)
    size_r, size_s = len(r) + private_r, len(s) + private_s
    if size_r > size_s:
        r, s, size_r, size_s = s, r, size_s, size_r
    similar = len(r & s) + 1e-9 >= t * (size_r + size_s - len(r & s))
    rarity = lambda x: sorted((1 + v % 5, v) for v in x)
    posted, instead = rule.posted(size_s, rarity(s))
    assert set(rule.probes(size_r, rarity(r))[0]) & set(posted) or r & {v for _, v in instead} or not similar


@pytest.mark.parametrize("seed,t,least,largest,group", [(1, 0.5, 5, 1 << 17, 10_000), (2, 0.8, 1, 1 << 17, 10_000), (3, 0.34, 2, 1 << 17, 2), (4, 0.5, 2, 8, 3), (5, 0.5, 1, 0, 1)])
def test_similar_pairs_against_brute_force(spark, monkeypatch, seed, t, least, largest, group):
    monkeypatch.setattr(setjoin, "GROUP", group)
    sets = random_sets(seed)
    sets["big"] = {f"own{i}" for i in range(500)}
    sets["copy1"] = sets["copy2"] = sets["copy3"] = {"a", "b", "c", "d", "e"}
    rows = [("f", o, v, 1) for o, vs in sets.items() for v in vs]
    rows += rows[:50] + [("f", None, "v1", 1), ("f", "s1", None, 1), (None, "s1", "v1", 1), ("g", "s1", "lonely", 1)]
    df = spark.createDataFrame(rows, "field string, owner string, value string, size int")
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least and len(x & y) + 1e-9 >= t * len(x | y):
            want.add(("f", a, b))
    got = [tuple(r) for r in setjoin.similar_pairs(df, t, least, largest).collect()]
    assert set(got) == want and len(got) == len(want) and ("f", "copy1", "copy2") in want
    pairs, members = setjoin.similar_classes(df, t, least)
    assert {r.rep for r in members.collect() if r.owner.startswith("copy")} == {next(r.rep for r in members.collect() if r.owner == "copy1")}
    assert all(r.similarity + 1e-9 >= t for r in pairs.collect())


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "field string, owner string, value string")
    assert setjoin.similar_pairs(df).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_pairs(df, threshold=0)


def test_piled_up_values_take_the_exact_way():
    rule = setjoin.Pigeonhole(0.5, 1)
    piled = [(1, (i * 5040 * 11 * 13) << 8) for i in range(1, 10)]  # all in one segment, whatever their number
    assert rule.posted(9, piled)[0] == [] and rule.posted(9, piled)[1]


# ---- leaked test texts


def matches_by_hand(doc, item, least):
    d, i = leak_index.words(doc), leak_index.words(item)
    runs = {tuple(i[k : k + least]) for k in range(len(i) - least + 1)}
    return any(tuple(d[k : k + least]) in runs for k in range(len(d) - least + 1))


@pytest.mark.parametrize("seed,least,block", [(1, 4, 10**6), (2, 3, 5)])
def test_phrases_against_brute_force(spark, seed, least, block):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(2, 15))) for i in range(12)] + [(90, None), (91, ""), (92, "short"), (93, "w1 " * 30)]
    docs = [(i, text(rng.randrange(0, 60), rng.choice([" ", "\r\n+ ", "_", " -- "])).upper()) for i in range(40)]
    docs += [(97, None), (98, ""), (99, "x" * 200_000 + " " + items[0][1])]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    hits = leak_index.phrase_matches(df, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"), least, block).collect()
    want = {(d, i) for d, dt in docs for i, it in items if matches_by_hand(dt, it, least)}
    assert {(h.doc_id, h.item_id) for h in hits} == want and want
    text_of, item_of = dict(docs), dict(items)
    for h in hits:
        d, i = leak_index.words(text_of[h.doc_id]), leak_index.words(item_of[h.item_id])
        assert d[h.doc_pos : h.doc_pos + h.n_words] == i[h.item_pos : h.item_pos + h.n_words] and h.n_words >= least


def test_proximity_and_empty(spark):
    item = " ".join(f"t{i}" for i in range(12))
    near = " ".join([*(f"t{i}" for i in range(6)), "inserted", *(f"t{i}" for i in range(6, 12))])
    docs = spark.createDataFrame([(1, item), (2, near), (3, " ".join(f"t{i}" for i in range(6)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r.doc_id, r.kind) for r in leak_index.leaks(docs, items, 12, 6).collect()}
    assert got == {(1, "phrase"), (2, "proximity")}
    assert {r.doc_id for r in leak_index.leaks(docs, items, 12).collect()} == {1}
    assert leak_index.phrase_matches(docs, items.limit(0)).count() == 0
    assert leak_index.phrase_matches(docs.limit(0), items).count() == 0


def test_chains_keep_order_and_slack(spark):
    a, b = [f"t{i}" for i in range(7)], [f"t{i}" for i in range(7, 14)]
    foreign = lambda n: [f"x{i}" for i in range(n)]
    texts = [b + a, a + foreign(8) + b, a + foreign(9) + b, a + foreign(15) + b, a + b[:5], a + a + b, ["y", *a, "y", *b[1:], "y"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(a + b))], "item_id long, text string")
    got = {r.doc_id: (r.kind, r.longest, r.covered) for r in leak_index.leaks(docs, items, 13, 6).collect()}
    assert got == {1: ("proximity", 7, 14), 5: ("phrase", 14, 14), 6: ("proximity", 7, 13)}
    tight = {r.doc_id for r in leak_index.leaks(docs, items, 13, 6, slack=0).collect()}
    assert tight == {5}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 6)), max_size=7), st.integers(0, 5))
def test_chains_against_all_chains(parts, slack):
    def follows(x, y):
        over = max(0, x[0] + x[2] - y[0], x[1] + x[2] - y[1])
        return x[0] < y[0] and x[1] < y[1] and over < y[2] and y[0] - x[0] - x[2] <= slack and y[1] - x[1] - x[2] <= slack, over

    def longest(x):
        return x[2] + max((longest(y) - follows(x, y)[1] for y in parts if follows(x, y)[0]), default=0)

    assert leak_index.covered_words(parts, slack) == max((longest(x) for x in parts), default=0)


def test_index_is_stored_once_for_all_item_blocks(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b c d e" if i else None) for i in range(9)], "doc_id long, text string")
    rows = leak_index.build_index(docs.repartition(2)).collect()
    assert sum(len(r.doc_ids) for r in rows) == 9
    for r in rows:
        assert len(r.bounds) == len(r.terms) + 1 and r.bounds[-1] == len(r.steps) and len(set(r.terms)) == len(r.terms)
        of_a = r.steps[r.bounds[r.terms.index("a")] : r.bounds[r.terms.index("a") + 1]]
        assert min(of_a) > 0 and len(of_a) == sum(i != 0 for i in r.doc_ids) and sum(of_a) < sum(len(d) + 9 for d in r.terms) * 9
    items = spark.createDataFrame([(i, "a b c d e") for i in range(5)], "item_id long, text string")
    hits = leak_index.phrase_matches(docs, items, 5, block_words=1)
    assert hits.count() == 8 * 5 and hits._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_words_of_any_script():
    assert leak_index.words("Ünï-côde_x9 日本 don't") == ["ünï", "côde", "x9", "日本", "don", "t"]


# ---- mixing


def test_budgets_pass_to_siblings_first():
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("code", "en", "d", 5000)]
    weights = {("web",): 0.5, ("code",): 0.5, ("web", "en"): 0.5, ("web", "de"): 0.5, ("web", "en", "a"): 0.5, ("web", "en", "b"): 0.5}
    root = mixing.budget_tree(leaves, weights, {("web",): 1, ("code",): 2}, total=4000)
    leaf = {path[:-1]: path[-1] for path in mixing.leaves_of(root, 3)}
    # a holds 100 of its 500, b takes the rest of en's share, c is not touched
    assert leaf["web", "en", "a"].budget == 100 and leaf["web", "en", "a"].short
    assert leaf["web", "en", "b"].budget == 900 and leaf["web", "de", "c"].budget == 1000
    assert leaf["code", "en", "d"].budget == 2000
    # with web full as a whole, code takes over
    root = mixing.budget_tree(leaves, weights, {("web",): 1, ("code",): 2}, total=6000)
    assert root.children["web"].budget == 2100 and root.children["web"].short
    assert root.children["code"].budget == pytest.approx(3900)
    root = mixing.budget_tree(leaves, weights, {("web",): 1, ("code",): 1}, total=10**6)
    assert sum(c.budget for c in root.children.values()) == 7100


def test_missing_and_untargeted_sources():
    root = mixing.budget_tree([("a", 10), (None, 30), ("x", 60)], {("a",): 0.9, ("ghost",): 0.1}, {("a",): 1, ("ghost",): 8})
    assert root.size == 100 and root.children["ghost"].short and root.children["a"].short
    assert root.children["x"].budget == 0 and root.children[None].budget == 0 and root.children["a"].budget == 10
    assert mixing.budget_tree([], {("a",): 1.0}, {("a",): 1}).children["a"].budget == 0


def test_selected_prefixes_fit_their_budgets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "de"]), rng.randrange(0, 50)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, name string, lang string, n_tokens long")
    root = mixing.budget_tree(mixing.leaf_sizes(sized, ["name", "lang"]), {("a",): 0.8, ("b",): 0.2}, {("a",): 3, ("b",): 1})
    chosen = mixing.select_mixture(sized, "doc_id", ["name", "lang"], root, seed=1).collect()
    assert chosen == mixing.select_mixture(sized, "doc_id", ["name", "lang"], root, seed=1).collect() or sorted(chosen) == sorted(mixing.select_mixture(sized, "doc_id", ["name", "lang"], root, seed=1).collect())
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(r.n_tokens > 0 for r in chosen)
    used = defaultdict(int)
    for r in chosen:
        used[r.name, r.lang] += r.n_tokens * r.copies
        assert r.copies <= {"a": 3, "b": 1}[r.name]
    for *path, node in mixing.leaves_of(root, 2):
        if node.budget:
            assert node.budget - 50 <= used[tuple(path)] <= node.budget
    other = {r.doc_id for r in mixing.select_mixture(sized, "doc_id", ["name", "lang"], root, seed=2).collect()}
    assert other != {r.doc_id for r in chosen}


def test_token_counts_of_whole_texts():
    assert mixing.count_tokens(None) == mixing.count_tokens("") == 0
    assert mixing.count_tokens("a line\n" * 30_000) == 30_000 * mixing.count_tokens("a line\n")
    # pieces of the split pattern, encoded one by one, add up at every length
    pattern, whole = regex.compile(mixing.SPLIT), mixing._tokenizer(mixing.TOKENIZER)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh", k=60_000)), "x = 1\n\n\n    y\n" * 6000, "\n \t" * 30_000 + "end", "word " * 9000 + " " * 50_000 + "?!" * 9000]
    for text in texts:
        assert len(text) > 40_000 and mixing.count_tokens(text) == sum(whole(m[0]) for m in pattern.finditer(text))


def fill_by_hand(weights, capacities, budget):
    """Water filling by bisection."""
    lo, hi = 0.0, 1e18
    for _ in range(300):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(c, w * level) for w, c in zip(weights, capacities)) < budget else (lo, level)
    return [min(c, w * hi) for w, c in zip(weights, capacities)]


def test_three_levels_of_budgets(spark, sf):
    _, targets, root, by_source = queries._budgets(spark, sf)
    assert root.budget == pytest.approx(sum(c.budget for c in root.children.values()))
    stack = [root]
    while stack:
        node = stack.pop()
        kids = [c for c in node.children.values() if c.weight > 0]
        if kids:
            want = fill_by_hand([c.weight for c in kids], [c.capacity for c in kids], node.budget)
            assert [c.budget for c in kids] == pytest.approx(want, abs=1e-3)
        stack += node.children.values()
    for t in targets:
        assert sum(n.wanted for n in by_source[t["name"]]) == pytest.approx(t["target_share"] * root.size)
    assert {len(path) for *path, _ in mixing.leaves_of(root, 3)} == {3}


def test_shortage_goes_to_the_sibling_first():
    row = lambda name, share, cap: {"name": name, "target_share": share, "max_repeats": cap}
    targets = [row("bitbarn", 0.4, 1), row("campus_git", 0.1, 9), row("mail_patches", 0.5, 9), row("ghost", 0.0, 1)]
    leaves = [("hosting", "en", "bitbarn", 100), ("hosting", "en", "campus_git", 400), ("lists", "en", "mail_patches", 500)]
    leaf = {path[-2]: path[-1] for path in mixing.leaves_of(queries._tree(leaves, targets), 3)}
    assert leaf["bitbarn"].short and leaf["bitbarn"].budget == 100
    assert leaf["campus_git"].budget == pytest.approx(400) and leaf["mail_patches"].budget == pytest.approx(500)
    with pytest.raises(ValueError):
        queries._tree(leaves, [*targets, row("ghost", 0.0, 1)])


def test_p8_found_against_tokens(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    name = lambda s: (s or "").strip().lower().replace("-", "_")
    size = Counter()
    for d in docs:
        size[name(d["source"])] += mixing.count_tokens(d["text"])
    targets = pq.read_table(f"{sf}/mix_targets.parquet").to_pylist()
    want = {t["source"] for t in targets if t["target_share"] * sum(size.values()) > t["max_repeats"] * size[name(t["source"])]}
    assert {r.source for r in queries.p8_found(spark, sf).collect()} == want and want
    shares = queries.p8_shares(spark, sf).collect()
    assert sum(r.share for r in shares) == pytest.approx(1) and all(r.tokens <= r.max_repeats * r.size for r in shares)


# ---- spam

HEAD = "commit 53f6a8f4870ab623a9c63beeae7a00d95655b443\nAuthor: d <d@mail.invalid>\nDate:   2023-02-09 19:00:14 +0000\n\n    "
SPAM = {
    "repeated phrase": "\n    ".join(["cheap importer trusted harness in Harbor buy importer near Vote"] * 8),
    "keywords": "\n    ".join(", ".join(random.Random(i).choices(["cheap shoes", "outlet bags", "free watches", "rabatt uhren"], k=8)) for i in range(9)),
    "links": "\n    ".join(f"https://best-{w}{i}.example/p" for i, w in enumerate(["shoes", "bags", "wine", "toys"] * 8)),
    "anchors": "\n    ".join(f'<a href="http://top-{w}{i}.test">hottest {w}</a> |' for i, w in enumerate(["grill", "drone", "sofa"] * 8)),
    "disguised": "\n    ".join(["h0tt3st grill h4ndm4d3 cruis3 in Orbit h4ndm4d3 grill n34r Bridg3"] * 7),
    "tags": "\n    ".join(f"{w} cheap | XL | ivory | SKU{7000 + i} | 13.99" for i, w in enumerate(["basket", "wallet"] * 10)),
}
HAM = {
    "prose": "The cache used to drop entries when the map was full.\n    Now it waits until the writer is done, so that nothing is lost.\n    " * 5,
    "code": "\n".join(f"+    x{i} = load(path, {i})\n+    if x{i} is None:\n+        return {i}" for i in range(20)),
    "sql": "\n".join(f"+INSERT INTO product (id, name) VALUES ({i}, 'cheap casino {i}');" for i in range(30)),
    "owners": "\n".join(f"+/lib/part{i}/ @team-a{i} @team-b" for i in range(30)),
    "resources": "\n".join(f"+* [Item {i}](https://best-shoes{i}.example/{i}): this makes the reader wait for the writer instead of the cache." for i in range(12)),
    "lock": "\n".join(f'+"pkg-{i}@^1.2.{i}":\n+version "1.2.{i}"\n+resolved "https://registry.a.example/pkg/-/pkg-{i}.tgz#05a{i}"' for i in range(12)),
}


def test_spam_and_its_neighbours(spark, sf):
    files = {"code": "x.py", "sql": "x.sql", "owners": "CODEOWNERS", "resources": "x.md", "lock": "yarn.lock"}
    diff = lambda name: f"Update\n\ndiff --git a/{name} b/{name}\nindex 044c60b..b321903 100644\n--- a/{name}\n+++ b/{name}\n@@ -1,1 +1,2 @@\n"
    filler = [f"Fix the {a} of the {b} before the {c} is read.\n    It turned out that the {b} had {i} entries for one {a}, so we check the {c} first." for i, (a, b, c) in enumerate(itertools.permutations(["cache", "reader", "writer", "parser", "lexer", "index"], 3))]
    rows = [(k, HEAD + "note\n\n    " + t, "en") for k, t in SPAM.items()]
    rows += [(k, HEAD + (diff(files[k]) + t if t.startswith("+") else t), "en") for k, t in HAM.items()]
    rows += [(f"f{i}", HEAD + t, "EN") for i, t in enumerate(filler)]
    rows += [("null", None, None), ("empty", "", "und"), ("long", "word " * 3 + "q" * 3_000_000, "en"), ("line", "a=b;" * 500_000, None)]
    # what is redundant for a language only a corpus tells
    rows += [(f"owners{k}", HEAD + diff("CODEOWNERS") + "\n".join(f"+/lib/part{i * k}/ @team-{i + k} @team-b" for i in range(10 + k)), "en") for k in range(spam.RARE)]
    rows += [(f"corpus{d['doc_id']}", d["text"], d["lang"]) for d in pq.read_table(f"{Path(sf).parent}/sf0.01/documents.parquet").to_pylist()]
    ids = {i: r[0] for i, r in enumerate(rows)}
    df = spark.createDataFrame([(i, t, lang, 0) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, ratio int")
    got = {ids[r.doc_id] for r in spam.stuffed_documents(df).collect()}
    assert got & SPAM.keys() == SPAM.keys()
    # neither measure decides alone
    assert len(got) < spam.stuffed_documents(df, deviations=-100.0).count() and len(got) < spam.stuffed_documents(df, max_closed=1.0).count()
    assert not got & HAM.keys(), got & HAM.keys()
    assert not {g for g in got if g.startswith("f")} and not got & {"null", "empty"}
    assert spam.stuffed_documents(df.limit(0)).count() == 0


def test_compression_is_block_wise():
    assert list(spam.blocks(b"")) == []
    noise = bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))
    ratio = lambda data: sum(p for _, p in spam.blocks(data)) / len(data)
    assert ratio(b"ab" * 2000) < 0.1 < 0.9 < ratio(noise)
    # a block knows nothing of the others
    assert sum(p for _, p in spam.blocks(noise[:512] * 8)) > 8 * 500
    assert all(256 < raw <= 768 for raw, _ in spam.blocks(bytes(5000)))


def test_lines_closed_like_sentences_or_statements():
    for line in ("It is done.", "Really?", "x = 1;", "}", "def f(a):", "foo(a, b)", 'he said "so."'):
        assert spam.closed(line), line
    for line in ("cheap shoes", "best bags; cheap bags; new", "a b; c d;", "https://a.example/x.", "* [cheap](https://a.example)", "<a href='x'>bag</a>", ""):
        assert not spam.closed(line), line


def test_content_by_language():
    diff = "diff --git a/x.SQL b/x.SQL\nindex 044c60b..b321903 100644\n--- a/x.SQL\n+++ b/x.SQL\n@@ -1,1 +1,2 @@\n-old\n+new\n same\ndiff --git a/y.md b/y.md\n-gone\n"
    assert spam.sections(HEAD + "subject\n\n" + diff, "en") == {"en": ["subject"], ".sql": ["new", "same"]}
    assert spam.sections(diff, "de") == {".sql": ["new", "same"], "de": ["gone"]}


def test_queries_have_their_columns(spark, sf):
    columns = {"p2_found": "field item", "p4_found": "userid_a userid_b", "p6_found": "field userid_a userid_b", "p7_found": "doc_id item_id", "p8_found": "source", "p9_found": "doc_id"}
    for name, wanted in columns.items():
        assert queries.QUERIES[name](spark, sf).columns == wanted.split(), name
    assert json.dumps(sorted(queries.ORACLE))


def test_pages_of_reference_lines_and_short_stuffing(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvw", k=7))
    said = [f"Fix the {word()} of the {word()} before the {word()} is {word()}.\n    " for _ in range(60)]
    texts = {
        "labelled": "\n    ".join(f"cheap {w}: https://{w}{i}.example/x" for i, w in enumerate(["toys", "shoes", "bags"] * 8)),
        "see": "\n    ".join(f"See https://shop{i}.example buy cheap toys" for i in range(20)),
        "short": "buy cheap toys outlet " * 5,
        "cited": "".join(said[:9]) + "Release notes: https://a.example/1\n    See https://b.example/2",
        "brief": "Fix typo in parser",
    }
    filler = [*said, *["".join(said[i : i + 12]) for i in range(0, 48, 6)]]
    names = [*texts, *[f"f{i}" for i in range(len(filler))]]
    rows = [(i, HEAD + "note\n\n    " + t, "en") for i, t in enumerate([*texts.values(), *filler])]
    rows += [(len(names) + i, d["text"], d["lang"]) for i, d in enumerate(pq.read_table(f"{Path(sf).parent}/sf0.01/documents.parquet").to_pylist())]
    found = spam.stuffed_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {names[r.doc_id] for r in found if r.doc_id < len(names)} == {"labelled", "see", "short"}
