"""Quotation linking against SQL on random conversations, and known cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.llm import quotes
from fathomline.llm.oracles import QUOTES

SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows):
    df = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))
    return {(r["conv_id"], r["position"]): r for r in df.collect()}


def by_sql(df):
    duck = duckdb.connect()
    duck.register("conversations", df.toArrow())
    got = duck.execute(QUOTES)
    names = [x[0] for x in got.description]
    return sorted((dict(zip(names, r, strict=True)) for r in got.fetchall()), key=lambda r: str(sorted(r.items())))


def check(df):
    mine = quotes.link_quotes(df).withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).drop("text")
    assert sorted((r.asDict() for r in mine.collect()), key=lambda r: str(sorted(r.items()))) == by_sql(df)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 3)
    rng = random.Random(seed)
    lines = ["Hi,", "Thanks!", "ok", "", "  ", *[f"The budget is {k} euro" for k in range(8)], *[f"long line number {k} of some length" for k in range(8)]]
    rows = []
    for conv in (1, 2, 3, None):
        said = []
        for turn in range(rng.randint(3, 14)):
            text = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    picked = rng.choice(said).split("\n")
                    cut = rng.randint(0, len(picked) - 1)
                    text += [rng.choice(["> ", ">", " > "]) + x for x in picked[cut : cut + rng.randint(1, 5)]]
                else:
                    text += [">" * rng.randint(1, 3) + " " + rng.choice(lines) for _ in range(rng.randint(1, 3))]
                text += [rng.choice(lines) for _ in range(rng.randint(0, 3))]
            said.append("\n".join(text))
            rows.append((conv, rng.choice([turn, turn, turn // 2, None]), rng.choice(["u", "a", None]), rng.choice([said[-1], said[-1], said[-1], None])))
    check(spark.createDataFrame(rows + rows[:2], SCHEMA))


def test_the_line_that_tells_outweighs_the_common_one(spark):
    got = found(spark, [(1, 0, "u", "Hi\nThe budget is 7"), (1, 1, "a", "fine"), (1, 2, "u", "Hi\nsomething else"), (1, 3, "a", "> Hi\n> the BUDGET is 7\nagreed"), (2, 0, "u", "> Hi\nwho?")])
    assert (got[1, 3]["parent_position"], got[1, 3]["depth"], got[1, 3]["text"]) == (0, 1, "agreed")
    assert (got[2, 0]["parent_conv"], got[2, 0]["depth"]) == (None, 0)


def test_a_quote_of_a_later_message_ends(spark):
    got = found(spark, [(1, 0, "u", "a first one"), (1, 1, "a", "more"), (1, 2, "u", "> later line\n"), (1, 3, "a", "x"), (1, 4, "u", "later line\n> later line")])
    assert [got[1, k]["parent_position"] for k in range(5)] == [None, 0, 1, 2, 3]
    assert [got[1, k]["depth"] for k in range(5)] == [0, 1, 2, 3, 4]


def test_a_passage_of_another_conversation(spark):
    rows = [(1, 0, "u", "One line here\nand another there"), (1, 1, "a", "ok"), (2, 0, "u", "> One line here\n> and another there\nsee above"), (2, 1, "u", "> ok\nyes"), (3, 0, "u", "ok")]
    got = found(spark, rows)
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_position"], got[2, 0]["depth"]) == (1, 0, 0)
    assert (got[2, 1]["parent_conv"], got[2, 1]["parent_position"]) == (2, 0)  # "ok" stands in two others
    check(spark.createDataFrame(rows, SCHEMA))


def test_long_texts_hot_lines_and_extra_columns(spark):
    long = "\n".join(f"> line {k}" if k % 2 else f"line {k - 1}" for k in range(20_000))
    rows = [(1, k, "u", "ok\n> ok" if k else "ok") for k in range(300)] + [(2, 0, "u", "line 1\n\nline 3"), (2, 1, "a", long), (2, 2, "a", ">" * 500 + " deep"), (2, 3, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.withColumn("position", F.lit(5)).withColumn("_row", F.lit("x")).withColumn("level", F.lit(1)).select("conv_id", "turn", "role", "text", "position", "_row", "level"))


def test_nothing(spark):
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []
