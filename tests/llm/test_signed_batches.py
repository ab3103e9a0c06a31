import pytest
from pyspark.sql import functions as F

from quernel.llm import queries, tokencounts


def test_query_revises_deletes_and_inserts_again(spark, monkeypatch):
    seen, commit = {}, tokencounts.Rollup.commit

    def watched(self, batch, changes):
        done = commit(self, batch, changes)
        if done:
            seen[batch] = tuple(spark.read.parquet(f"{self.path}/batches/{batch}").selectExpr("sum(d_docs)", "sum(abs(d_tokens))").first())
        return done

    monkeypatch.setattr(tokencounts.Rollup, "commit", watched)
    sf = "/root/testdata/sf0.001"
    totals = queries.op3_token_counts(spark, sf).groupBy("tokenizer").sum("n_docs").collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {tuple(t) for t in totals} == {("words-1", n), ("pieces-2", n)}
    assert seen["delete-words-1"][0] == -n and seen["again-words-1"][0] == n
    assert seen["revise-pieces-2"][0] == 0 and seen["revise-pieces-2"][1] > 0


def one(spark, n):
    return tokencounts.inserts(spark.createDataFrame([("a", "en", "v1", n)], "source string, lang string, tokenizer string, n_tokens long"))


def state(roll):
    return [tuple(r)[3:] for r in roll.totals().collect()]


@pytest.mark.parametrize("after", ["_snapshot", "_names", "_held", "_sums", "_moved"])
def test_a_batch_that_lands_during_compaction_counts_once(spark, tmp_path, monkeypatch, after):
    roll, late = (tokencounts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    roll.commit("one", one(spark, 10))
    assert roll.compact()
    roll.commit("two", one(spark, 3))
    step, landed = getattr(roll, after), []

    def then_lands(*args):
        out = step(*args)
        if not landed:
            landed.append(late.commit("late", one(spark, 5)))
        return out

    monkeypatch.setattr(roll, after, then_lands)
    assert roll.compact() and landed == [True]
    assert state(late) == [(3, 18)]
    assert late.compact() and late.compact() and state(late) == [(3, 18)]
    assert not late.commit("late", one(spark, 5)) and not late.commit("one", one(spark, 10)) and late._names("batches") == []


@pytest.mark.parametrize("during", ["_names", "_held", "_sums", "_moved"])
def test_one_compaction_at_a_time(spark, tmp_path, monkeypatch, during):
    roll, other = (tokencounts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    roll.commit("one", one(spark, 10))
    roll.commit("two", one(spark, 5))
    before = roll.totals()
    step, tried = getattr(roll, during), []

    def with_another(*args):
        if during == "_names" and args != ("batches",):
            return step(*args)
        tried.append(other.compact())
        return step(*args)

    monkeypatch.setattr(roll, during, with_another)
    assert roll.compact() and set(tried) == {False}
    monkeypatch.undo()
    assert state(other) == [(2, 15)] and state(roll) == [(2, 15)]
    # whoever planned a read before can still run it
    assert [tuple(r)[3:] for r in before.collect()] == [(2, 15)]


def test_a_claim_left_behind_is_taken_over(spark, tmp_path, monkeypatch):
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    roll.commit("one", one(spark, 10))
    (tmp_path / "r/snapshots/.claim-00000001").touch()
    assert not roll.compact()
    monkeypatch.setattr(tokencounts, "STALE", -10)
    assert roll.compact() and state(roll) == [(1, 10)]


def test_counts_of_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all; BPE counts as the library does."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    texts = [None, "", "two words", "two words", "x" * 50_000 + " y" * 50_000, "é ü 日本"]
    df = spark.createDataFrame([(t, None, "s") for t in texts], "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("_text", "n_tokens", "tokenizer", "words-1", tokencounts.BPE)})
    got = tokencounts.all_counts(df, queries.tokenizer_path()).collect()
    assert sorted(r[tokencounts.BPE] for r in got) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r["words-1"] for r in got) == sorted(len((t or "").split()) for t in texts)
    assert tokencounts.all_counts(df.where("false"), queries.tokenizer_path()).count() == 0
    assert [r.n_tokens for r in tokencounts.counted(df, "words-1").where("n_tokens > 0").orderBy("n_tokens").collect()] == [2, 2, 3, 50_001]


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op3_token_counts(spark, str(tmp_path)).count() == 0
