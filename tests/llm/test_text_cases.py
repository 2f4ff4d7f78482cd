"""Cases in which the text operators once did less than the whole job."""

from fathomline.llm import decontam, license, urlfilter


def test_all_who_link_to_a_blocked_host_are_blocked(spark):
    spam = '<a href="http://spam.net/x">'
    pages = [("http://spam.net/x", None), ("http://top.net/", None), ("http://lone.com/", '<a href="http://top.net/">')]
    pages += [(f"http://farm{k}.com/", spam) for k in range(100)]
    # a hub with one such link of a hundred, one with trust, and one two steps away
    pages += [("http://hub.com/", spam + "".join(f'<a href="http://site{k}.com/">' for k in range(99))), ("http://far.com/", '<a href="http://farm0.com/">')]
    pages += [("http://good.org/fr/", '<a href="http://known.com/">'), ("http://known.com/", spam)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in urlfilter.judge_urls(df).collect()}
    assert all(got[f"farm{k}.com"] == "block" for k in range(100))
    assert got["lone.com"] == "block" and got["far.com"] == "block"
    assert got["hub.com"] == "allow" and got["known.com"] == "allow" and got["good.org"] == "allow"


def test_items_with_swapped_halves_are_found(spark):
    item = [f"w{k}" for k in range(56)]
    swapped = item[28:] + item[:28]
    text = [f"a{k}" for k in range(40)] + swapped + [f"b{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(swapped)), (3, " ".join(text[:60]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1]["start"] == 40 and abs(got[1]["similarity"] - 48 / 56) < 1e-9
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [3]


def test_key_phrases_at_the_beginning_of_the_text(spark):
    heads = {
        "MIT License": "mit", "Apache License Version 2.0": "apache-2.0", "GNU General Public License version 3": "gpl-3.0", "CC BY-NC 4.0": "cc-by-nc",
        "License Version 2.0": None, "MIT": None,
    }
    df = spark.createDataFrame([(k, t) for k, h in enumerate(heads) for t in (h, f"{h} and more words", f"one two three {h}")], "doc_id long, text string")
    for r in license.scan_licenses(df).collect():
        label = list(heads.values())[r["doc_id"]]
        assert (label in r["labels"] and 0 < r["score"] <= 1) if label else (r["labels"] == [] and r["score"] == 0)
