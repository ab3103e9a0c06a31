import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from compare import assert_same, duck
from quernel.llm import decontaminate, neardup, tokencounts, topk, warc
from quernel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_what_sql_says(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])


# top-k


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 6)).astype(np.float32)
    x[100:400] = x[100]  # a very common vector, and ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (None, x[0].tolist()), (903, [float("inf")] * 6), (920, [0.5, 0.25]), (940, [1.0, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5, shard=100, block=8).collect()
    q = np.floor(64 * x.astype(float)).astype(int)
    expected = set()
    for i in range(0, 700, 20):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(700) if j != i)[:5]
        expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(order)}
    expected |= {(920, 1, 940, 32 * 64 - 16 * 64), (940, 1, 920, 32 * 64 - 16 * 64)}
    assert {tuple(g) for g in got} == expected and len(got) == len(expected)


def test_top_k_of_large_components_and_of_nothing(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    big = [(0, [3.0e7, 1.0]), (20, [3.0e7, 2.0]), (3, [1e300, 0.0])]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(big, schema), F.col("vec_id") == 0).collect()] == [(0, 1, 20, (64 * 30_000_000) ** 2 + 64 * 128)]


# token counts


def counts(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens long, old_tokens long")


def test_rollup_is_signed_and_idempotent(spark, tmp_path):
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    first = counts(spark, [("a", "en", "v1", 10, 0), ("a", "en", "v1", 5, 0), (None, None, "v1", 2, 0)])
    state = lambda: {tuple(r) for r in roll.totals().collect()}
    assert state() == set()
    assert roll.commit("one", tokencounts.inserts(first)) and not roll.commit("one", tokencounts.inserts(first))
    assert state() == {("a", "en", "v1", 2, 15), (None, None, "v1", 1, 2)}
    roll.compact()
    assert not roll.commit("one", tokencounts.inserts(first))
    assert roll.commit("two", tokencounts.deletes(counts(spark, [("a", "en", "v1", 5, 0), (None, None, "v1", 2, 0)])))
    assert roll.commit("three", tokencounts.revisions(counts(spark, [("a", "en", "v1", 12, 10)])))
    assert roll.commit("empty", tokencounts.inserts(counts(spark, [])))
    assert state() == {("a", "en", "v1", 1, 12)}
    roll.compact()
    assert state() == {("a", "en", "v1", 1, 12)} and not roll.commit("three", tokencounts.inserts(first))
    with pytest.raises(ValueError):
        roll.commit("../x", tokencounts.inserts(first))


# near-duplicates


def check_groups(spark, docs, size, num):
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=size, num=num).collect()
    expected = brute.groups(docs, size, num)
    assert len(got) == len(docs)
    for r in got:
        assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    return got


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size, num, represented", [(3, 85, 64), (5, 80, 64), (3, 85, 3), (5, 80, 3), (5, 80, 10**9)])
def test_families_are_brute_force(spark, size, num, represented, monkeypatch):
    monkeypatch.setattr(neardup, "REPRESENTED", represented)
    monkeypatch.setattr(neardup, "KEY_BLOCK", 16)  # many blocks, as in very large families
    monkeypatch.setattr(neardup, "LEAST_BLOCK", 16)
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = variants(r, base, 150, 12) + variants(r, [f"v{i}" for i in range(40)], 20, 3) + [" ".join(base)] * 5
    texts += ["License text that is shared here", "one two", "one two", "ONE\tTwo", "one", "", "   "] + [f"x{i} y{i} z{i}" for i in range(50)] + [" ".join(base[:60]) + f" q{i} r{i}" for i in range(40)]
    texts += [" ".join(base[: 60 + 3 * i]) for i in range(20)]  # a chain of growing texts over many bands of sizes
    texts += [" ".join(f"long{j}" for j in range(20_000)) + e for e in (" a", " b", " c d e")]
    r.shuffle(texts)
    check_groups(spark, list(enumerate(texts)), size, num)


def test_documents_are_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = check_groups(spark, docs, 3, 85)
    sizes = {i: len(brute.shingles(t, 3)) for i, t in docs}
    assert all(g.n_shingles == sizes[g.doc_id] for g in got)


def test_a_long_member_meets_few(spark, monkeypatch):
    """Pairs that are dealt: of a large family hardly any, and none of members whose sizes rule a link out."""
    rows = [(i, 7, 1000) for i in range(3000)] + [(9000, 7, 500_000), (9001, 7, 450_000), (9002, 7, 5)]
    family = spark.createDataFrame(rows, "node long, label long, n long")
    inside = spark.createDataFrame([(i, 0) for i in range(2990)], "node long, rep long")
    dealt = neardup._left_to_test(family, inside, 80, 100)
    pairs = {}
    for r in dealt.collect():
        pairs.setdefault(r.pair, set()).add(r.node)
    assert sum(map(len, pairs.values())) < 2 * len(rows) and all(len(p & {9000, 9001}) in (0, len(p)) for p in pairs.values())
    assert any(p >= {9000, 9001} for p in pairs.values()) and not any(9002 in p for p in pairs.values())
    for out in range(2990, 3000):
        assert set.union(*(p for p in pairs.values() if out in p)) == set(range(3000))


def test_near_duplicates_with_nulls_and_repeats(spark):
    rows = [(1, None), (None, "a b c d"), (2, "a b c d"), (3, "A b C d"), (3, "A b C d"), (4, "x y z w v"), (4, "k l m n o"), (5, "k l m n o"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(g.doc_id), g.n_shingles, str(g.component_id), g.kept) for g in neardup.near_duplicates(df, shingle=3, num=85).collect())
    assert got == [("1", 0, "1", True), ("2", 2, "2", True), ("3", 2, "2", False), ("3", 2, "2", False), ("4", 3, "4", True), ("4", 3, "4", True), ("5", 3, "4", False), ("6", 0, "6", True), ("None", 2, "None", True)]
    assert sorted(str(g.doc_id) for g in neardup.deduplicated(df.withColumn("sig", F.lit(1)), shingle=3, num=85).collect()) == ["1", "2", "4", "6", "None"]
    assert neardup.near_duplicates(df.where("false")).count() == 0


# WARC


def test_archives_round_trip(spark, tmp_path):
    big, rows = "p" * 1500, []
    rows += [(i, f"http://a/{i}", big) for i in (3, 7, 5)] + [(7, "http://a/7", big), (1, None, "short"), (2, "http://a\r\nX: y", "short"), (4, "u", None), (None, "u", big), (9, "é", "WARC/1.1\r\n\r\n" * 200), (8, "u", "ü" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    made = warc.monolithic(warc.classified(pages), archive_bytes=2000)
    archives = warc.normalise(made)
    got = warc.read(archives).collect()
    html = {(r[0], r[2]) for r in rows}
    assert len(got) == len(rows)
    for g in got:
        kind, refers = ("revisit", 7) if g.page_id in (3, 5, None) else ("response", None)
        assert (g.record_type, g.refers_to) == (kind, refers)
        if kind == "response":
            assert any(i == g.page_id and (h or "").encode() == bytes(g.payload) for i, h in html)
    files = warc.export_files(archives, f"file://{tmp_path}/out").collect()
    for f in files:
        data = (tmp_path / "out" / f"{f.name}.warc.gz").read_bytes()
        index = (tmp_path / "out" / f"{f.name}.idx").read_text().splitlines()
        assert len(list(warc.records(warc.inflated(data)))) == len(index)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_bad_archives():
    whole = warc.member(warc.record(1, "u", b"x" * 5000, "response", None))
    with pytest.raises(ValueError):
        warc.normalised(whole[:-20])
    with pytest.raises(ValueError):
        warc.normalised(b"no gzip at all")
    with pytest.raises(ValueError):
        warc.normalised(warc.member(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))
    content, index = warc.normalised(whole + whole)
    assert [e["offset"] for e in index] == [0, index[0]["length"]] and len(content) == sum(e["length"] for e in index)


# decontamination


def test_hits_are_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("a b c d e é ñ X 7".split())
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 13, 14, 20])))) for i in range(25)] + [(99, None), (None, "q r s"), (3, "repeated id of an item")]
    docs = [(i, "".join(word() + r.choice([" ", ", ", "-", "\n"]) for _ in range(r.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (502, "q r s"), (503, " ".join(items[20][1].split() * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("other", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):  # in one pass, and in several
        got = {g.doc_id: g for g in decontaminate.contaminated(df, bench, pattern_bytes=size).collect()}
        for i, t in docs:
            n, hit, names = brute.hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, [x for x in names if x != "None"])
            assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    assert decontaminate.contaminated(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0
    assert dict(decontaminate.contaminated(df.withColumn("n_hit", F.lit("x")), bench).dtypes)["n_hit"] == "bigint"


def test_wu_manber_jumps():
    bench = decontaminate.Benchmark([("x", "a b c d")], 4)
    (search,) = bench.tables
    text = decontaminate.Words(b"z z a b c d a b c d")
    jumps = search.jump(decontaminate._blocks(text.hash, 2)[2:]).tolist()
    assert jumps == [3, 3, 2, 1, 0, 3, 2, 1, 0]
    assert [x.tolist() for x in search.search([text])] == [[0, 0], [2, 6], [0, 0]]
    assert bench.search([text, decontaminate.Words(b"A-b--C!d"), decontaminate.Words(b"")]) == [([2, 10], ["x"]), ([0, 4], ["x"]), ([], [])]


def test_words_of_long_texts(monkeypatch):
    """Words keep their hash wherever pieces begin, and a word may be longer than a piece."""
    whole = decontaminate.Words(b"ab cd " * 50 + b"x" * 300 + b" ab \xc3\xa9")
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    monkeypatch.setattr(decontaminate, "_POWERS", [])
    pieces = decontaminate.Words(b"ab cd " * 50 + b"x" * 300 + b" ab \xc3\xa9")
    assert len(whole) == len(pieces) == 103 and whole.start.tolist() == pieces.start.tolist() and whole.end.tolist() == pieces.end.tolist()
    same = whole.hash == pieces.hash
    assert same.sum() == 102 and not same[100] and len(set(whole.hash.tolist())) == 4 and pieces.shown(100, 1) == b"x" * 300


def test_a_large_benchmark_goes_in_passes(spark, monkeypatch):
    """Passes are jobs of their own: a plan never holds more than one search, nor a pass more than its share of the items."""
    held, one = [], decontaminate._pass

    def watched(df, items, *more):
        held.append(len(items))
        out = one(df, items, *more)
        assert str(out._jdf.queryExecution().toString()).split("== Physical Plan ==")[1].count("MapInArrow") == 1
        return out

    monkeypatch.setattr(decontaminate, "_pass", watched)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)]
    docs = [(i, "a b " + " ".join(f"w{i}x{j}" for j in range(15)) + " c " + " ".join(f"w{i + 1}x{j}" for j in range(13))) for i in range(50)] + [(0, "a b c"), (None, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), pattern_bytes=sum(len(t) for _, t in items) // 12 + 1)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(held) == 12 and sum(held) == 60 and max(held) < 20 and plan.count("MapInArrow") == 1
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.hit_spans), tuple(r.item_ids)) for r in got.collect())
    assert rows == sorted([(str(i), 31, 28, (2, 17, 18, 31), tuple(sorted([str(i), str(i + 1)]))) for i in range(50)] + [("0", 3, 0, (), ()), ("None", 0, 0, (), ())])
