"""The pipeline's stages against brute force, each on what the one before kept, and the defined cases."""

import collections
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_leaks, check_tokens, rows, tokens, words

import corpus_pipeline
from fathomline.llm import decontam, license, mixing, sharding, urlfilter
from fathomline.llm.oracles import LICENSES, QUALITY


def through(spark, docs, sf, tmp, until=4):
    """Each stage's input and output, as the run makes them."""
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[: until + 1]):
        path = f"{tmp}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def check_stages(spark, docs, sf, tmp):
    quality, near, clean, mixed, token = through(spark, docs, sf, tmp)
    assert [x[0] for x in (quality, near, clean, mixed, token)] == ["quality_rules", "near_duplicates", "decontamination", "source_mixing", "token_output"]
    for _, _, after in (quality, near, clean, mixed):
        assert after.columns == docs.columns
    duck = duckdb.connect()
    all_rows = rows(docs.select("doc_id", "text"))  # numbered for the SQL, which takes a doc_id as one row
    duck.register("documents", pa.table({"doc_id": list(range(len(all_rows))), "text": pa.array([r["text"] for r in all_rows], pa.string())}))
    kept = collections.Counter(str(all_rows[r[0]]["doc_id"]) for r in duck.execute(f"SELECT doc_id FROM ({QUALITY}) WHERE kept").fetchall())
    assert collections.Counter(str(r["doc_id"]) for r in rows(quality[2])) == kept
    before = [r for r in rows(near[1])]
    first = {i for i, _, c in brute_components(before, 5) if c == i} | {"None"}
    got = [str(r["doc_id"]) for r in rows(near[2])]
    assert set(got) == {str(r["doc_id"]) for r in before if str(r["doc_id"]) in first}
    assert sum(g != "None" for g in got) == len(set(got) - {"None"}) and got.count("None") == sum(r["doc_id"] is None for r in before)
    items = rows(spark.read.parquet(f"{sf}/benchmark.parquet"))
    shingles = {tuple(t[i : i + 5]) for x in items for t in [tokens(x["text"])] for i in range(len(t) - 4)}
    short = [x for x in items if len(tokens(x["text"])) < 5]
    may = [r for r in rows(clean[1]) if short or any(tuple(t[i : i + 5]) in shingles for t in [tokens(r["text"])] for i in range(len(t) - 4))]
    leaked = {d for d, _ in brute_leaks(may, items)}
    assert sorted(str(r["doc_id"]) for r in rows(clean[2])) == sorted(str(r["doc_id"]) for r in rows(clean[1]) if r["doc_id"] not in leaked)
    taken = collections.Counter()
    for r in rows(mixed[2]):
        taken[str(r["doc_id"])] += len(words(r["text"]))
    plan = collections.Counter()
    for r in rows(mixing.mix_plan(mixed[1])):
        plan[str(r["doc_id"])] += r["taken"]
    assert +taken == +plan
    whole = {(r["doc_id"], r["text"]) for r in rows(mixed[1])}
    cut = [r for r in rows(mixed[2]) if (r["doc_id"], r["text"]) not in whole]
    assert len(cut) <= mixed[1].select("source").distinct().count()
    texts = collections.defaultdict(list)
    for d, t in whole:
        texts[d].append(t)
    assert all(any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in cut)
    assert token[2].count() == mixed[2].count() and [f.name for f in token[2].schema][:3] == ["doc_id", "start", "n_tokens"]
    ends = sorted((r["start"], r["n_tokens"]) for r in rows(token[2]))
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_stages_on_the_documents(spark, sf, tmp_path):
    check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, str(tmp_path))


def test_stages_on_odd_rows(spark, sf, odd_docs, tmp_path):
    longer = odd_docs.withColumn("text", F.when(F.col("doc_id") > 3, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" and it was the best of all the days that they had"))))
    extra = longer.withColumn("row_key", F.lit("mine")).withColumn("_k", F.lit(1)).withColumn("_w", F.lit(2.0)).withColumn("component_id", F.lit(None).cast("long"))
    check_stages(spark, extra, sf, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/2")
    assert {r["row_key"] for r in rows(kept)} <= {"mine"} and {r["_w"] for r in rows(kept)} <= {2.0}


def test_stages_on_nothing(spark, sf, no_docs, tmp_path):
    assert [after.count() for _, _, after in through(spark, no_docs, sf, str(tmp_path))] == [0] * 5


# --- operators whose whole results were not compared ----------------------------------------------
def test_leaks_with_insertions_and_deletions(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((36, 50, 45, 60, 4, 50))]
    items[5] = (5, items[1][1].replace("i1w3 ", "other "))  # most of its shingles are another's
    docs = []
    for d in range(60):
        words_ = [f"d{d}x{j}" for j in range(rng.randint(0, 60))]
        base = items[d % 6][1].split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(base))
            if rng.random() < 0.5:
                base.insert(at, f"new{d}")
            elif len(base) > 2:
                del base[at]
        at = rng.randint(0, len(words_))
        docs.append((d, " ".join(words_[:at] + base + words_[at:])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(df, bench))}
    want = brute_leaks([{"doc_id": d, "text": t} for d, t in docs], [{"item_id": i, "text": t} for i, t in items])
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 25


def test_groups_stay_whole(spark):
    """Every group that a shard can hold is in one shard, however few rows a shard has."""
    spread = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 240, F.concat(F.lit("g"), (F.col("id") % 60).cast("string"))).otherwise(F.concat(F.lit("s"), "id")).alias("text"))
    by = collections.defaultdict(set)
    for r in rows(sharding.shard_documents(spread)):
        if r["doc_id"] < 240:
            by[r["doc_id"] % 60].add(r["shard"])
    assert sum(len(s) == 1 for s in by.values()) == 60


def test_linked_rows_alone_fill_the_shards(spark):
    linked = spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("g"), (F.col("id") % 300).cast("string")).alias("text"))
    found = rows(sharding.shard_documents(linked))
    sizes = collections.Counter(r["shard"] for r in found)
    by = collections.defaultdict(collections.Counter)
    for r in found:
        by[r["doc_id"] % 300][r["shard"]] += 1
    pairs = sum(n * (n - 1) // 2 for c in by.values() for n in c.values())
    assert set(sizes.values()) == {100} and pairs > 0.8 * 300 * 28


def test_licenses_against_sql(spark, sf, odd_docs):
    for df in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd_docs.select("doc_id", "text")):
        duck = duckdb.connect()
        duck.register("documents", df.toArrow())
        starts = F.transform("base_places", lambda x: x["start"].cast("long"))
        got = license.scan_licenses(df).select("doc_id", "n_words", F.size("base_places").cast("long"), F.array_min(starts), F.array_max(starts), F.array_join("base_labels", ","), F.array_join("labels", ","), F.round("score", 6))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duck.execute(LICENSES).fetchall()))


def test_licenses_of_nothing_and_clashing_columns(spark, no_docs):
    assert rows(license.scan_licenses(no_docs)) == []
    df = spark.createDataFrame([(1, "cc by", "kept", 7)], "doc_id long, text string, rare string, words int")
    r = rows(license.scan_licenses(df))[0]
    assert r["rare"] == "kept" and r["labels"] == ["cc-by"] and r["words"] == ["cc", "by"]


@pytest.mark.parametrize("repeat", [1, 3])
def test_urls_of_nothing_and_repeated(spark, repeat):
    schema = "page_id long, url string, html string, host string"
    assert rows(urlfilter.judge_urls(spark.createDataFrame([], schema))) == []
    one = [(1, "http://a.com/x", '<a href="http://spam.net/">', "z"), (2, None, None, None), (3, "http://spam.net/", "", None)]
    got = rows(urlfilter.judge_urls(spark.createDataFrame(one * repeat, schema)))
    assert len(got) == 3 * repeat and {(r["page_id"], r["verdict"]) for r in got} == {(1, "block"), (2, "allow"), (3, "block")}


def test_near_duplicates_refuse_other_ids(spark):
    from fathomline.llm import neardup

    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_token_files_hold_their_documents(spark, odd_docs):
    from fathomline.llm import tokenout

    check_tokens(rows(tokenout.token_output(odd_docs.withColumn("ids", F.lit(1)).withColumn("start", F.lit("x")), tokenout.default_tokenizer())), rows(odd_docs))
