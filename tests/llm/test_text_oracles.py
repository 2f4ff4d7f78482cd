"""Every text query with SQL gives the SQL's rows; the rank's SQL is compared where there are links."""

import duckdb
import pytest

from fathomline.llm import queries, urlfilter
from fathomline.llm.oracles import URLS

TABLES = "documents pages benchmark labels conversations".split()


def same(df, duck, sql):
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name])


def test_verdicts_by_links_against_sql(spark):
    import random

    rng = random.Random(3)
    hosts = [f"h{k}.com" for k in range(30)] + ["spam.net", "a.net", "good.org", "x.example.com", "y.example.net"]
    pages = []
    for k in range(120):
        links = "".join(f"<a HREF='http://{rng.choice(hosts).upper()}/p'>" for _ in range(rng.randint(0, 5)))
        pages.append((k, f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'en/', ''])}", rng.choice([links, links, None])))
    df = spark.createDataFrame(pages + pages[:3] + [(500, None, None), (501, "no scheme", "")], "page_id long, url string, html string")
    duck = duckdb.connect()
    duck.register("pages", df.toArrow())
    found = urlfilter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict")
    assert found.filter("rule is null and verdict = 'block'").count() > 0 and found.filter("rule is null and verdict = 'allow'").count() > 0
    same(found, duck, URLS)
