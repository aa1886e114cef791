import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import filter_audit, merkle, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Mask int, g string, digest string, leaf string, part string, h int, x int, body int"


def docs(spark, rows, parts=5):
    """Rows (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), 1, "g", "d", "l", "p", 2, 3, 4) for k, t, s in rows], DOCS).repartition(parts)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- filter interaction audit


def masks(rows):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, t, s in rows:
        t = t or ""
        w = t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        upper = sum("A" <= c <= "Z" for c in t)
        yield k, s or "", frozenset(x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(t), any(c in "#$%&*|" for c in t), k is not None and least[t] < k)) if bad)


def audited(rows, labels):
    good, bad = ({r[0] for r in labels if r[0] is not None and r[n] == 1} for n in (1, 2))
    parts = defaultdict(list)
    for k, part, m in masks(rows):
        parts[part].append((k, m))
    out, total = {}, Counter()
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [(k, m) for k, m in left if f in m]
                stay = [(k, m) for k, m in left if f not in m]
                redundant = sum(f in m for _, m in members) - len(gone)
                out[part, order, step] = [len(stay), len(gone), redundant, sum(m == {f} for _, m in members), sum(k in good for k, _ in gone), sum(k in bad for k, _ in gone)]
                total[part, f] += len(gone)
                left = stay
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def audit_rows(rng):
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n\x0b\x0c\r", "ünï | çødé", "A" * 40, "a b " * 60, "A bc " * 60, " ".join(words[:60]), " ".join(words[:60]) + " ", "x\x0by " * 30]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice((20, 60, 90)))) + rng.choice(("", "", " #", " 100%")) for _ in range(30)]
    hot = " ".join(words[:70])  # a third of all rows
    rows = [(rng.randrange(300), hot if rng.random() < 0.35 else rng.choice(texts), rng.choice(("s", "s", "s", "t", None, ""))) for _ in range(400)]
    return [*rows, (None, hot, "s"), (None, hot, "t"), (7, hot, "u"), (7, hot, "u")]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_audit_against_brute_force(spark, monkeypatch, parts):
    rng = random.Random(parts)
    rows = audit_rows(rng)
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert told(filter_audit.audit(docs(spark, rows), labelled(spark, labels))) == audited(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    rng = random.Random(3)
    rows = audit_rows(rng)
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda c: F.length(c).cast("long") % 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = filter_audit.failure_masks(docs(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter((k, p, sum(1 << "ABCDE".index(f) for f in m)) for k, p, m in masks(rows))
    assert Counter((r.doc_id, r.part, r["mask"]) for r in found) == want


def test_audit_of_nothing_and_of_very_long_texts(spark, monkeypatch):
    assert filter_audit.audit(docs(spark, []), labelled(spark, [])).count() == 0
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    text = (" ".join(f"word{k % 900}" for k in range(20_000)) + " \n" + "Z" * 300).encode()
    assert filter_audit.failures(text) == 2
    assert [filter_audit.failures(t) for t in (b"", b" ", "é".encode() * 20 + b"A")] == [1, 1, 1]
    assert told(filter_audit.audit(docs(spark, [(1, "a", None)]), labelled(spark, []))) == audited([(1, "a", None)], [])


# --- Merkle manifest


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((i % 3, "".join(run[: i % 3] + run[i % 3 + 1 :])))
        i //= 3
    return out


def manifest(rows):
    groups = defaultdict(list)
    for k, t, s in rows:
        groups[s].append((k, leaf((k, s, "en", len(t or ""), t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x for _, x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    above = tree([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, (k, x) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((k, x, trees[s][-1][0], above[-1][0], tuple(proof(trees[s], i) + proof(above, n))))
    return Counter(out)


def proved(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((p.position, p.others) for p in r.proof)) for r in df.collect())


@pytest.mark.parametrize("n, groups", [(0, 1), (1, 1), (2, 1), (4, 4), (40, 30), (600, 3), (900, 1)])
@pytest.mark.parametrize("parts", [1, 9])
def test_manifest_against_brute_force(spark, n, groups, parts):
    rng = random.Random(n + parts)
    names = [None, "", "é", "Z", *(f"s{k}" for k in range(groups))][:groups]
    rows = [(rng.randrange(10_000), rng.choice((None, "", "a\nb", "漢" * 5, f"t{k}")), rng.choice(names[:1] * groups + names)) for k in range(n)]
    if n > 100:
        rows += rows[:5] * 20 + [(None, "x", names[0]), (None, None, names[0])]  # repeated rows and null ids
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = merkle.manifest(docs(spark, rows))
        assert proved(found) == manifest(rows)
        assert found.where(merkle.folded("leaf", "proof") != F.col("root")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_what_was_changed_is_not_verified(spark):
    rows = [(k, f"line {k}\nnext" if k % 3 else f"line {k}", f"s{k % 2}") for k in range(50)]
    bare = merkle.leaf_digest(*(F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in ("doc_id", "source", "lang", "n_chars", "text")))
    found = merkle.manifest(docs(spark, rows), presented=bare).select("doc_id", "leaf", "presented", (merkle.folded("presented", "proof") == F.col("root")).alias("same"), merkle.proof_digest("proof").alias("p"), "proof").collect()
    assert {r.doc_id for r in found if not r.same} == {k for k in range(50) if k % 3}
    assert all((r.leaf == r.presented) == r.same and r.p == h(*(s.others for s in r.proof)) for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_subtrees_cover_every_cut(n):
    leaves = [h(str(k)) for k in range(n)]
    sizes, whole = merkle.level_sizes(n), tree(leaves)
    assert sizes == [len(x) for x in whole]
    for a in range(n):
        for b in range(a + 1, n + 1):
            levels = merkle.subtrees(leaves[a:b], a, sizes)
            assert all(whole[k][lo : lo + len(x)] == x for k, (lo, x) in enumerate(levels))
            edges = list(merkle.ragged(levels))
            covered = sorted(i for k, j, _ in edges for i in range(j * 3**k, min((j + 1) * 3**k, n)))
            assert covered == list(range(a, b)) and len(edges) <= 4 * len(sizes)


# --- toxicity


def distance(a, b):
    """Optimal string alignment distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_the_distance_to_each_term(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 60)
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))) for _ in range(25)})
    lexicon = toxicity.Lexicon({t: 1.0 + k / 100 for k, t in enumerate(terms)}, {}, frozenset())
    trie = toxicity.Trie(lexicon)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "c", "cd"])
        word = "".join(word)
        near = [(e, -w, t) for t, w in lexicon.words.items() if (e := distance(word, t)) <= toxicity.allowed(t)]
        found = trie.find(word)
        assert (found is None) == (not near)
        if near:
            assert (found[2], -found[1], found[0]) == min(near)


LEXICON = toxicity.Lexicon({"stupid": 6.0, "worthless": 5.0, "scum": 4.0}, {"lowei": 3.0}, frozenset({"stupa"}))


def test_finds_and_their_context():
    def finds(text):
        return toxicity.Finder(LEXICON).finds(text)[1]

    assert finds("A STUPID, thing") == [("stupid", 6.0, 0, 1.0)]
    assert [f[0] for f in finds("st*pid stuipd wortless w0rthles5 sc*m stupa loweitum lowe")] == ["stupid", "stupid", "worthless", "worthless", "lowei"]
    assert finds("you are stupid")[0][3] == toxicity.AIMED
    assert finds('he wrote of "how you are stupid" there')[0][3] == toxicity.QUOTED  # the reporting word is too far away, the address is quoted
    assert finds('he said "stupid"')[0][3] == toxicity.QUOTED * toxicity.REPORTED
    assert finds("> stupid\nstupid") == [("stupid", 6.0, 0, toxicity.QUOTED), ("stupid", 6.0, 0, 1.0)]
    assert finds('an open " mark and stupid')[0][3] == 1.0
    assert [f[3] for f in finds("„stupid“ «scum» scum")] == [toxicity.QUOTED, toxicity.QUOTED, 1.0]
    assert [round(x, 3) for x in toxicity.Finder(LEXICON).features(None)] == [0, 0, 0, 0, 0]


def test_quotation_scores_below_abuse_and_misspellings_count(spark):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        if toxic := k % 5 == 0:
            for term in ("stupid", "scum", "worthless"):
                if rng.random() < 0.8:
                    words[rng.randrange(40)] = term
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(toxic)))
    base = " ".join(plain[:30])
    extra = [
        (1000, f"{base} you are stupid and worthless"), (1001, f'{base} she wrote: "stupid and worthless"'), (1002, f"{base} you are stup1d and worhtless"), (1003, base), (1004, None), (1005, ""),
        (None, base), (1003, base), (1006, (base + "\n") * 5000 + "stupid scum"), (1007, "stupid " * 200_000), (1008, "," * 5000),
    ]
    found = toxicity.assess(docs(spark, [*rows, *((k, t, "s") for k, t in extra)]), labelled(spark, labels)).collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[1000] > 0.7 and score[1001] < score[1000] and score[1003] < score[1002] and score[1007] > 0.7
    assert score[1003] == score[1004] == score[1005] == score[1008] == score[None] < 0.1
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97


def test_toxicity_without_labels_and_without_rows(spark):
    none = labelled(spark, [])
    assert {r.score for r in toxicity.assess(docs(spark, [(1, "a", "s"), (2, None, "s")]), none).collect()} == {0.5}
    assert toxicity.assess(docs(spark, []), none).count() == 0
    one_class = toxicity.assess(docs(spark, [(k, "a b", "s") for k in range(30)]), labelled(spark, [(k, 1, 0) for k in range(30)])).collect()
    assert len({r.score for r in one_class}) == 1 and one_class[0].score < 0.1


def test_labels_of_an_id_with_many_rows_stay_within_the_bounds(spark):
    rows = [(k, f"text {k} scum", "s") for k in range(30)] + [(2, f"again {k}", "s") for k in range(200)]
    model = toxicity.train(docs(spark, rows), labelled(spark, [(k, 1, k % 2) for k in range(30)]), toxic_rows=5, clean_rows=5)
    assert model.weights == [0.0] * len(toxicity.FEATURES) or model.lexicon is not None


def test_toxicity_of_held_out_rows_of_the_test_table(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.assess(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in found if r.toxic == 1], [r.predicted for r in found if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.005
