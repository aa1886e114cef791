import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import components, decontaminate, exact_dedup, golay, langid, license_scan, near_dedup, oracle, piece_sampling, quality, queries, simhash, substring_dedup, token_counts, url_filter

from ..oracle import connect, rows_of_spark, rows_of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Names that the operators use inside, and some in another case.
CLASHES = (
    "Digest gone told found row body ws w h low at base blocks u_host q_host q_path u_path best rank short doc spans Spans __doc __spans __row __text __base rep key fp "
    "c n a b bag cells leak item_id start starts words shingles crowd s class asks hub label share first last section keep_id points group_size known id doc_id_ path_"
).split()


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(dict.fromkeys(c.lower() for c in CLASHES))]) if extra else df


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (None, "one two three"), (6, "x " * 30_000), (7, "ünï çødé 漢字 ▁ \U0001f600"), (4, "one")]


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "north", "south", "river", "stone", "light", "quiet", "green")) + str(rng.randrange(60)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    names, want = rows_of_sql(connect(sf), oracle.ORACLE_SQL[name])
    assert sorted(df.columns) == names and rows_of_spark(df) == want


OPERATORS = {
    "leaks": lambda d: decontaminate.leaks(d, d.where("text is null or length(text) < 1000").selectExpr("doc_id as item_id", "text")),
    "keep_clean": lambda d: decontaminate.keep_clean(d, d.selectExpr("doc_id as item_id", "text").limit(0)),
    "passages": substring_dedup.passages,
    "without_repeats": substring_dedup.without_repeats,
    "components": simhash.near_components,
    "license_blocks": license_scan.blocks,
    "near_keep": near_dedup.keep_one,
    "identify": langid.identify,
    "keep_identified": langid.keep_identified,
    "tokenize": piece_sampling.tokenize,
    "quality": lambda d: quality.assess(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")),
    "assign": exact_dedup.assign,
    "exact_keep": exact_dedup.keep_one,
    "tokens": token_counts.count,
    "license": license_scan.scan,
    "urls": lambda d: url_filter.judge(d, url_filter.rule_table(d.sparkSession, queries.URL_RULES), url="text"),
}
ONE_EACH = {"components", "identify", "tokenize", "quality", "assign", "license", "urls"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_and_empty_tables(spark, name, extra):
    full = docs(spark, ODD, extra)
    n = len(OPERATORS[name](full).collect())
    if name in ONE_EACH:
        assert n == len(ODD)
    assert OPERATORS[name](full.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**23 - 1), st.lists(st.integers(0, 22), max_size=2))
def test_golay_two_errors_share_a_codeword(v, flips):
    w = v
    for f in flips:
        w ^= 1 << f
    a, b = (set(golay.codeword_keys(np.array([x])).ravel().tolist()) - {-1} for x in (v, w))
    assert a & b


def brute_fingerprint(text):
    words = [w.encode() for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").split(" ")] if text else []
    words = b" ".join(words).split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, "")]
    for k in range(3, 60):
        base = prose(rng, 300)
        rows.append((k * 10, base))
        if k % 2:
            words = base.split()
            words[rng.randrange(300)] = "changed"
            rows.append((k * 10 + 1, " ".join(words)))
    rows += [(5000 + k, rows[2][1]) for k in range(200)]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_components(docs(spark, rows)).collect()}
    prints = {k: brute_fingerprint(t) for k, t in rows}
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {k: (prints[k], find(k)) for k in prints}


def test_crowded_keys_lose_no_link(spark):
    base = 0x0123456789ABCDEF
    points = sorted({base ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, k) for k, p in enumerate(points)], "fp long, rep long")
    for bits in (2, 8):
        found = components.connected_components(simhash.links(df, bits, crowd=3))
        assert {r.component for r in found.collect()} == {0} and found.count() == len(points)


def test_star_steps_name_their_input_twice(spark):
    """Plans of several steps would else grow too large for the driver; a path of nodes and a hub still become one component each."""
    rows = [(k + 1, k) for k in range(9)] + [(k, 20) for k in range(21, 30)]
    pairs = spark.createDataFrame(rows, "u long, v long")
    once = components._small_star(components._large_star(pairs))
    assert once._jdf.queryExecution().analyzed().collectLeaves().size() <= 4
    found = {r.node: r.component for r in components.connected_components(pairs, "u", "v").collect()}
    assert found == {k: 0 if k < 10 else 20 for k in [*range(10), *range(20, 30)]}


def test_near_duplicates_keep_one(spark):
    rng = random.Random(3)
    base = prose(rng, 400).split()
    copy = list(base)
    for k in range(0, 400, 100):
        copy[k] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, prose(rng, 400)), (4, prose(rng, 400)), (5, "")]
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.columns == DOCS.replace("long", "").replace("string", "").replace(",", "").split()
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5}


def kept_by_brute_force(rows):
    """Ids that stay if all pairs that meet under a key at ten bits or fewer are held against the cosine of 0.8."""
    texts = {k: t.encode().split() for k, t in rows}
    prints = {k: simhash.fingerprint(w, 1, True) for k, w in texts.items()}
    bags = {k: near_dedup.shingle_set(w, 5) for k, w in texts.items()}
    ids = sorted(texts)
    at, keys = simhash.key_rows(np.array([prints[k] for k in ids], np.uint64), 10)
    keys_of = defaultdict(set)
    for i, key in zip(at.tolist(), keys.tolist(), strict=True):
        keys_of[ids[i]].add(key)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 10 and keys_of[a] & keys_of[b] and near_dedup.cosine(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


def kept_by_cosine(rows):
    """Ids that stay if all pairs of texts are compared, by shingles that few others hold (the prefix that a cosine of 0.8 can't do without)."""
    bags = {k: near_dedup.shingle_set(t.encode().lower().split(), 5) for k, t in rows}
    df, root, held = Counter(), {k: k for k in bags}, defaultdict(list)
    for b in bags.values():
        df.update(b.tolist())

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in sorted(bags, key=lambda k: len(bags[k])):
        n = len(bags[k])
        rare = sorted(bags[k].tolist(), key=lambda s: (df[s], s))[: n - int(np.ceil(0.64 * n - 1e-9)) + 1]
        for other in {o for s in rare for o in held[s]}:
            if find(other) != find(k) and near_dedup.cosine(bags[k], bags[other]) >= 0.8:
                x, y = sorted((find(k), find(other)))
                root[y] = x
        for s in rare:
            held[s].append(k)
    return {k for k in bags if find(k) == k or not len(bags[k])}


def edited(rng, n, least, most):
    """An original of 300 words in mid-order and n copies with up to `most` edited words each."""
    base = prose(rng, 300).split()
    rows = [(n // 2, " ".join(base))]
    for k in range(n):
        copy = list(base)
        for i in rng.sample(range(300), rng.randint(least, most)):
            copy[i] = f"edit{rng.randrange(10**6)}"
        rows.append((k if k < n // 2 else k + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("n", "least", "most", "crowd", "listed"), [(300, 9, 9, 64, 512), (500, 3, 24, 64, 512), (500, 3, 24, 8, 20), (250, 18, 18, 8, 20)])
def test_near_copies_under_crowded_keys(spark, monkeypatch, n, least, most, crowd, listed):
    """No link that the keys propose is lost, none is made up, and nearly all that is alike is found, whichever way a crowd goes."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    rows = edited(random.Random(8), n, least, most)
    got, truth = {r.doc_id for r in near_dedup.keep_one(docs(spark, rows)).collect()}, kept_by_cosine(rows)
    assert truth <= got <= kept_by_brute_force(rows) and len(rows) - len(got) >= 0.9 * (len(rows) - len(truth))


def test_candidates_grow_with_the_texts(spark, monkeypatch):
    """Copies that are alike in their words but in part not in their shingles are not all paired with each other, whether their keys are crowded or not."""
    pairs, verified = [], near_dedup.verified

    def counted(asked, held, similarity):
        pairs.append(asked.count())
        return verified(asked, held, similarity)

    monkeypatch.setattr(near_dedup, "verified", counted)
    rows = edited(random.Random(14), 500, 3, 40)
    got, truth = {r.doc_id for r in near_dedup.keep_one(docs(spark, rows)).collect()}, kept_by_cosine(rows)
    assert 0 < sum(pairs) <= 40 * len(rows)
    assert truth <= got and len(rows) - len(got) >= 0.9 * (len(rows) - len(truth))


def test_prefix_join_loses_no_pair(spark, monkeypatch):
    """All pairs of two components with a cosine of 0.8 are among its pairs, whatever their sizes, and few others."""
    monkeypatch.setattr(near_dedup, "MORE_BITS", 64)
    rng = random.Random(15)
    rows = []
    for k, text in enumerate([*(t for _, t in edited(rng, 150, 0, 30)), *(t for _, t in edited(rng, 50, 0, 9))]):
        words = text.split()
        at = rng.randrange(60)
        rows.append((k, " ".join(words[at : len(words) - rng.randrange(60)])))
    rows += [(1000, "one two"), (1001, "one two"), (1002, "three")]
    df = docs(spark, rows)
    texts = df.select(F.col("doc_id").alias("rep"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("more"), (F.col("doc_id") / 3).cast("long").alias("c"))
    held = near_dedup.bags(df, texts.select("rep"), "text", "doc_id", 5)
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(texts, held, 64, 0.8).collect()}
    bags = {k: near_dedup.shingle_set(t.encode().lower().split(), 5) for k, t in rows}
    apart = [(a, b) for a in bags for b in bags if a < b and a // 3 != b // 3]
    alike = {p for p in apart if near_dedup.cosine(bags[p[0]], bags[p[1]]) >= 0.8}
    assert len(alike) > 500 and alike <= got and len(got) < len(apart) / 2


def test_near_duplicates_of_the_test_table(spark):
    rows = [(r.doc_id, " ".join(r.text.split())) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").collect()]
    first = {}
    for k, t in sorted(rows):
        first.setdefault(t, k)
    rows = [(k, t) for t, k in first.items() if t]
    truth = kept_by_cosine(rows)
    got = {r.doc_id for r in near_dedup.keep_one(docs(spark, rows)).collect()}
    assert truth <= got and len(rows) - len(got) >= 0.9 * (len(rows) - len(truth))


def test_ids_of_several_texts_are_left_alone(spark):
    rng = random.Random(13)
    a, b = prose(rng, 200), prose(rng, 200)
    near = a.replace(a.split()[100], "edited")
    rows = [(1, a), (2, near), (2, b), (3, a + " more"), (3, a + " more"), (None, a)]
    assert sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(docs(spark, rows)).collect()) == sorted([(1, a), (2, near), (2, b), (0, a)])


def test_texts_of_one_fingerprint_are_not_taken_for_one_text(spark):
    rng = random.Random(12)
    words = prose(rng, 240).split()
    other = words[::-1]
    moved = other[20:] + other[:20]
    edited = list(moved)
    edited[100] = "edited"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(moved)), (4, " ".join(edited)), (5, " ".join(words).upper())]
    assert len({simhash.fingerprint(t.lower().encode().split(), 1, True) for _, t in rows[:3]}) == 1
    assert {r.doc_id for r in near_dedup.keep_one(docs(spark, rows)).collect()} == {1, 2}


def test_exact_dedup_spills_and_matches(spark):
    rng = random.Random(9)
    texts = [prose(rng, 20) for _ in range(40)] + ["a b", "ab", None, "", " "]
    rows = [(k, rng.choice(texts)) for k in range(400)]
    want, groups = {}, defaultdict(list)
    for k, t in rows:
        groups["".join((t or "").split())].append((-len(t or ""), k))
    for g in groups.values():
        for _, k in g:
            want[k] = (min(g)[1], len(g))
    for size in (1, 64 << 20):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.assign(docs(spark, rows), table_bytes=size).collect()}
        assert got == want
        assert {r.doc_id for r in exact_dedup.keep_one(docs(spark, rows), table_bytes=size).collect()} == {k for k, _ in want.values()}


@pytest.mark.parametrize("bound", [0, 200_000])
def test_exact_dedup_keeps_one_of_repeated_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "DROPPED_BROADCAST", bound)
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a  b"), (2, "a  b"), (2, "c"), (3, "c"), (3, "d"), (None, "d"), (None, "e"), (None, "e"), (4, None), (5, "")]
    got = exact_dedup.keep_one(docs(spark, rows).withColumn("mark", F.lit(1)).withColumn("stays", F.lit(2)))
    assert got.columns[-2:] == ["mark", "stays"]
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == [(0, "e"), (2, "a  b"), (2, "c"), (3, "d"), (4, "")]


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_decontamination_against_all_windows(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 20 + 5 * k)) for k in range(6)]
    rows = []
    for k in range(40):
        words = prose(rng, 120).split()
        if k % 2:
            planted = items[k % 6][1].split()
            if k % 3 == 0:
                planted[len(planted) // 2] = "edited"
            at = rng.randrange(100)
            words[at:at] = planted
        rows.append((k, " ".join(words)))
    want = set()
    for k, t in rows:
        words = t.split()
        for i, item in items:
            n = len(item.split())
            a = shingles(item.split())
            for s in range(max(1, len(words) - n + 1)):
                b = shingles(words[s : s + n])
                shared = sum((a & b).values())
                if shared / (sum(a.values()) + sum(b.values()) - shared) >= 0.8:
                    want.add((k, i))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), df).collect()}
    assert got == want and want
    assert {r.doc_id for r in decontaminate.keep_clean(docs(spark, rows), df).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def weighted(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def test_a_full_leak_with_repeated_shingles_is_found(spark):
    item, text = "a a b a a b a b a a", "b a b a a z a b a a b a b a a b a a b b a a a b b"
    items = spark.createDataFrame([(1, item), (2, "x " * 3_000)], "item_id long, text string")
    rows = docs(spark, [(1, text), (None, item), (2, "x " * 20_000), (3, "y " * 20_000)])
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(rows, items).collect()}
    assert got == {(1, 1): 1.0, (None, 1): 1.0, (2, 2): 1.0}
    assert [r.doc_id for r in decontaminate.keep_clean(rows, items).collect()] == [3]


def test_windows_over_a_small_alphabet_lose_nothing(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("ab") for _ in range(rng.choice((3, 8, 10, 12))))) for k in range(12)]
    rows = [(k, " ".join(rng.choice("aab" if k % 2 else "abc") for _ in range(rng.randrange(1, 40)))) for k in range(400)]
    want = {}
    for i, item in items:
        n, k = len(item.split()), min(5, len(item.split()))
        count = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))  # noqa: B023, E731
        for d, text in rows:
            w = text.split()
            best = max(weighted(count(item.split()), b) if (b := count(w[j : j + n])) else 0 for j in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    found = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()} == want and len(want) > 20


def brute_passages(rows, run_words):
    """By each run of chunks: where it stands, and which words later occurrences alone cover."""
    at = defaultdict(list)
    for k, t in rows:
        for word, words, high, low in substring_dedup.run_rows(t.encode(), run_words):
            at[high, low].append((k, word, words))
    stays, goes = set(), set()
    for places in at.values():
        if len(places) > 1:
            for place in places:
                (stays if place[:2] == min(p[:2] for p in places) else goes).update((place[0], place[1] + j) for j in range(place[2]))
    return stays, goes - stays


def test_repeated_passages(spark):
    rng = random.Random(2)
    passage, other = prose(rng, 70), prose(rng, 60)
    rows = [(k, f"{prose(rng, 50 + k)} {passage} {prose(rng, 40)}") for k in range(4)] + [(10 + k, prose(rng, 150)) for k in range(6)]
    rows += [(20 + k, f"{prose(rng, 9 + k)} {other} {prose(rng, 5)} {passage if k else ''} {other if k == 2 else ''}") for k in range(3)]
    df = docs(spark, rows)
    stays, goes = brute_passages(rows, substring_dedup.RUN_WORDS)
    got_stays, got_goes = set(), set()
    for r in substring_dedup.passages(df).collect():
        (got_stays if r.first else got_goes).update((r.doc_id, r.start + j) for j in range(r.words))
    assert got_stays == stays and got_goes == goes
    assert {k for k, _ in stays | goes} == {0, 1, 2, 3, 20, 21, 22}
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    for k, t in rows:
        kept = [w for j, w in enumerate(t.split()) if (k, j) not in goes]
        assert left[k].split() == kept and (left[k] == t or any(d == k for d, _ in goes))
    # Where chunks fall in step only after some words, a run's first occurrence may be in a later copy, where it stays whole: so what is found is bounded, not what goes.
    assert left[0] == rows[0][1] and all(sum(d == k for d, _ in stays | goes) >= 40 and any(d == k for d, _ in goes) for k in (1, 2, 3))


def word_runs(rows, n):
    """Places (row, word) of words in runs of n words that stand at two places or more, over all rows with distinct (id, text)."""
    places = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].add((k, i))
    return {(k, i + j) for p in places.values() if len(p) > 1 for k, i in p for j in range(n)}


def test_ids_of_several_texts_and_null_ids_keep_their_own_words(spark):
    rng = random.Random(21)
    shared, alone = prose(rng, 80), prose(rng, 120)
    rows = [(1, f"{shared} {prose(rng, 30)}"), (2, f"{prose(rng, 20)} {shared}"), (2, alone), (None, f"{prose(rng, 15)} {shared}"), (None, prose(rng, 90)), (3, prose(rng, 50)), (3, None), (3, "")]
    rows += [(5, f"{shared} tail"), (5, f"{shared} tail")]  # a repeated row
    df = docs(spark, rows)
    found = substring_dedup.passages(df).collect()
    assert {r.doc_id for r in found} == {1, 2, None, 5} and len({(r.doc_id, r.text_id) for r in found}) == 4
    left = [(r.doc_id, r.text) for r in substring_dedup.without_repeats(df).collect()]
    assert len(left) == len(rows)
    kept = Counter(t for _, t in left)
    assert kept[alone] == kept[rows[4][1]] == kept[rows[5][1]] == kept[""] == kept[None] == 1  # nothing is cut where nothing repeats
    assert (1, rows[0][1]) in left  # the first occurrence stays
    may_go = word_runs(list(dict.fromkeys(rows)), 1)
    for (k, t), (j, u) in zip(sorted(rows, key=repr), sorted(left, key=repr), strict=True):
        assert k == j and len((u or "").split()) <= len((t or "").split())
    assert may_go and sum(len((t or "").split()) for _, t in left) < sum(len((t or "").split()) for _, t in rows) - 100


def test_what_goes_stands_elsewhere_and_most_of_a_long_passage_goes(spark):
    """Against all runs of words: nothing goes that isn't in a repeated run of RUN_WORDS words, and of long repeated passages most words of later copies go."""
    rng = random.Random(22)
    passages = [prose(rng, n) for n in (60, 120, 300)]
    rows = [(k, " ".join(x for p in rng.sample(passages, rng.randrange(3)) for x in (prose(rng, rng.randrange(5, 60)), p)) + " " + prose(rng, 40)) for k in range(24)]
    may = word_runs(rows, substring_dedup.RUN_WORDS)
    gone = {(r.doc_id, r.start + j) for r in substring_dedup.passages(docs(spark, rows)).collect() if not r.first for j in range(r.words)}
    assert gone <= may
    first = {p: min(k for k, t in rows if p in t) for p in passages if any(p in t for _, t in rows)}
    total = hit = 0
    for p, k0 in first.items():
        for k, t in rows:
            if p in t and k != k0:
                at = len(t[: t.index(p)].split())
                here = range(at, at + len(p.split()))
                total += len(here)
                hit += sum((k, i) in gone for i in here)
    assert total and hit >= 0.75 * total


def test_chunks_that_recur_one_by_one_are_no_passage(spark):
    rng = random.Random(6)
    lines = [prose(rng, 12) for _ in range(30)]
    rows = [(k, " ".join(rng.sample(lines, 12))) for k in range(8)]
    rows = [(k, t) for k, t in rows if not any(f"{a} {b}" in t and f"{a} {b}" in u for j, u in rows if j != k for a in lines for b in lines)]
    assert len(rows) > 1 and not substring_dedup.repeated(docs(spark, rows)).collect()


def test_language_and_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    told = [r for r in queries.op4_langid(spark, d).collect() if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in told]) > 0.97 and all(0 <= r.score <= 1 for r in told)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    scored = [(label[r.doc_id], r.predicted) for r in queries.op6_quality(spark, d).collect() if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in scored]) > 0.9


def test_labels_of_an_id_with_many_rows_stay_within_the_bound(spark, monkeypatch):
    rows = docs(spark, [(1, f"word {k}") for k in range(300)] + [(2, "a b")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, fit=quality.fit: (seen.append(len(y)), fit(x, y))[1])
    quality.train(rows, labels, sample_rows=10)
    assert seen == [10]


def test_every_language_is_learned(spark):
    codes = [f"q{a}{b}" for a in "abcdefghij" for b in "abcdef"]
    rows = docs(spark, [(n, f"{code} {code}x{k} " * 6) for n, (code, k) in enumerate((c, k) for c in codes for k in range(3))]).withColumn("lang", F.substring("text", 1, 3))
    model = langid.train(rows, sample_rows=100)
    assert sorted(model.families) == sorted(codes)


def test_texts_unlike_every_learned_language_go(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["qzxv kjwq zzxq vvkq " * 20, "x9 1 2 3 $$$ 00 " * 10, "привет как дела сегодня хорошая погода " * 5, "漢字仮名交じり文を書く" * 10]
    planted = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(junk)], DOCS)
    kept = {r.doc_id for r in langid.keep_identified(d.unionByName(planted)).select("doc_id").collect()}
    clean = {r.doc_id for r in d.where("length(text) >= 60").collect()}
    assert clean <= kept and not [k for k in kept if k >= 10**9]


@pytest.mark.parametrize("body", ["▁", "▁▂▃▅▇ load", "a ▁b▁ c", "▁ ▁"])
def test_space_marks_of_the_text_are_lossless(spark, body):
    (row,) = piece_sampling.tokenize(docs(spark, [(1, body)])).collect()
    assert row.lossless and piece_sampling.decode(row.ids) == body


def test_bytes_that_are_no_utf8(spark):
    bad = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe caf\xc3 \xe2\x96\x81 end\nline \xf0\x9f")), (2, bytearray(b"fine"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text", "'en' as lang")
    got = {r.doc_id: r for r in piece_sampling.tokenize(bad).collect()}
    assert got[1].lossless and got[2].lossless and piece_sampling.decode_bytes(got[1].ids) == b"ok \xff\xfe caf\xc3 \xe2\x96\x81 end\nline \xf0\x9f"
    counted = [r for r in token_counts.count(bad).collect() if r.doc_id == 1]
    assert [(r.first, r.last) for r in counted] == [(0, 19), (19, 26)] and sum(r.n_tokens for r in counted) == counted[0].of_document > 0
    for one in (langid.identify(bad), exact_dedup.assign(bad), near_dedup.keep_one(bad), license_scan.scan(bad), simhash.near_components(bad)):
        assert one.count() == 2


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=80), st.integers(-(2**62), 2**62))
def test_pieces_are_lossless_and_reproducible(body, key):
    a, b = piece_sampling.encode([body, "other " + body], [key, 1]), piece_sampling.encode([body], [key])
    assert piece_sampling.decode(a[0]) == body and a[0].tolist() == b[0].tolist()


def test_pieces_follow_the_weights():
    v = piece_sampling.vocabulary()
    word = "▁the"

    def paths(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                yield from ((ids[rest[:n]], *more) for more in paths(rest[n:]))

    ids = {p: i for i, p in enumerate(v.pieces)}
    weight = {p: float(np.exp(sum(v.logs[i] for i in p))) for p in paths(word)}
    total = sum(weight.values())
    n = 4000
    seen = Counter(tuple(x.tolist()) for x in piece_sampling.encode(["the"] * n, [int(k) * 7919 for k in range(n)]))
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        assert abs(seen[p] / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_brute_force(spark, rule):
    rng = random.Random(1)
    rows = [(1, "first line\n\nsecond  line, longer\n"), (2, "\n\nx"), (3, "no end 漢字"), (4, "a \n \n\t b\n\n\n\nc " * 20)] + [(5 + k, "".join(rng.choice(["word ", "\n", "\n\n", " ", "漢", "é\n", "...", "  x"]) for _ in range(80))) for k in range(20)]
    encoder, _ = token_counts._encoder(token_counts.RANKS)
    found = defaultdict(list)
    for r in token_counts.count(docs(spark, rows), rule=rule).collect():
        found[r.doc_id].append(r)
    for k, t in rows:
        data, mine = t.encode(), sorted(found[k], key=lambda r: r.section)
        owner = [next(r.section for r in mine if r.first <= at < r.last) for at in range(len(data))]
        counts, at = Counter(), 0
        for token in encoder.encode_ordinary(t):
            spans = owner[at : at + len(encoder.decode_single_token_bytes(token))]
            at += len(spans)
            counts[{"start": spans[0], "end": spans[-1], "majority": min(spans, key=lambda s: (-spans.count(s), s))}[rule]] += 1
        assert [r.n_tokens for r in mine] == [counts[r.section] for r in mine] and {r.of_document for r in mine} == {sum(counts.values())}
        assert [t[r.first_char : r.last_char] for r in mine] == [data[r.first : r.last].decode() for r in mine] and mine[-1].last == len(data)


def test_token_rules_on_a_crossing_token():
    ends, starts = np.array([3, 8, 10]), np.array([0, 4])
    assert [token_counts.attribute(ends, starts, r)[0].tolist() for r in token_counts.RULES] == [[2, 1], [1, 2], [1, 2]]
    assert token_counts.attribute(np.array([2, 6]), np.array([0, 4]), "majority")[0].tolist() == [2, 0]  # two bytes each: the earlier


def test_license_blocks_cross_lines_and_have_the_length_of_their_template(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the Software)"
    ordinary = "please read this text you and may not use this with any file of the other kind except where in doubt the compliance of it with all is a license or may obtain to copy at"
    found = {r.doc_id: r for r in license_scan.scan(docs(spark, [(1, wrapped), (2, ordinary), (3, "ÄMIT under the mit license"), (4, None)])).collect()}
    assert (found[1].labels, found[1].score, found[1].blocks[0].start) == ("mit", 1.0, 0)
    assert (found[2].labels, found[2].score) == ("", 0.0) and (found[3].n_base, found[3].first_word, found[4].n_words) == (1, 1, 0)


def test_every_license_block_is_found(spark):
    """Against a walk over all windows: overlapping ones are one block, the next begins behind it."""
    rng = random.Random(31)
    template, label = license_scan.TEMPLATES[0]
    grant = template.split()
    bag, n = set(grant), len(grant)
    short = [w for k, w in enumerate(grant) if k % 9]

    def filler(k):
        return [f"f{rng.randrange(999)}" for _ in range(k)]

    rows = [(1, grant + filler(40) + grant), (2, grant + grant), (3, filler(7) + short + filler(3) + grant + filler(90) + short), (4, filler(200)), (5, grant[: n // 2]), (6, (grant + filler(2)) * 9)]
    got = defaultdict(list)
    for r in license_scan.scan(docs(spark, [(k, " ".join(w)) for k, w in rows])).collect():
        got[r.doc_id] = sorted((b.start, round(b.share, 9)) for b in r.blocks or [] if b.label == label and b.length == n)
    for k, w in rows:
        want = []
        for at in range(max(1, len(w) - n + 1)):
            held = len(bag & set(w[at : at + n]))
            if held < license_scan.CONTAINMENT * len(bag) - 1e-9:
                continue
            if not want or at >= want[-1][0] + n:
                want.append((at, held))
            elif held > want[-1][1]:
                want[-1] = (at, held)
        assert got[k] == [(at, round(held / len(bag), 9)) for at, held in want]
    assert len(got[1]) == 2 and len(got[2]) == 2 and len(got[3]) == 3 and len(got[6]) == 9


def test_equal_url_rules_of_both_kinds_block(spark):
    rules = url_filter.rule_table(spark, [("allow", "a.org", "/x"), ("block", "a.org", "/x")])
    (row,) = url_filter.judge(spark.createDataFrame([(1, "http://a.org/xy")], "page_id long, url string"), rules).collect()
    assert (row.rule, row.verdict) == ("a.org/x", "block")


def test_url_precedence(spark):
    rows = [(1, "http://A.Example.com/en/7x?q"), (2, "https://example.com/en/8"), (3, "no scheme"), (4, None), (5, "http://example.net/de/88#f"), (6, "http://org/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rule_table(spark, queries.URL_RULES)).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("example.net/de/8", "block") and got[6][3] == "block"


def test_url_rules_are_the_contract_s(spark):
    rows = [(1, "http://a.net/de/x"), (2, "https://example.net/de/7"), (3, "https://example.net/de/8"), (4, "http://a.com/en/x"), (5, "http://example.com/en/7"), (6, "http://a.org/es/")]
    judged = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, queries.URL_RULES))
    got = {r.page_id: (r.rule, r.verdict) for r in judged.collect()}
    assert got[1] == got[2] == ("net/de/", "allow") and got[3] == ("example.net/de/8", "block")
    assert got[4] == ("com/en/", "block") and got[5] == ("example.com/en/7", "allow") and got[6] == ("org/es/", "block")
