"""Text operators against brute force, exact round trips and held-out likelihood."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import decontam, hmm, license, mixing, neardup, quality, quotes, sharding, tokenout, urlfilter

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ALNUM = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def tokens(t):
    return [w for w in ALNUM.split((t or "").translate(LOWER)) if w]


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- token output ------------------------------------------------------------------------------
@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(3000)), [0] * 700 + [2**41] * 3, [k * k for k in range(2000)]])
def test_elias_fano_round_trip(values):
    e = tokenout.EliasFano.from_bytes(tokenout.EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert e.decode().tolist() == values
    assert [e.select(i) for i in range(0, len(values), 13)] == values[::13]
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1000, 50_000))
    assert len(tokenout.EliasFano.of(v).to_bytes()) * 8 < 50_000 * (2 + math.log2(v[-1] / 50_000) + 1)


def check_tokens(found, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenout.default_tokenizer())
    expected, at = [], 0
    for d in sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((d["doc_id"], at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in found), key=lambda r: r[1])
    assert got == expected


def test_token_output_odd_rows(odd_docs):
    check_tokens(rows(tokenout.token_output(odd_docs, tokenout.default_tokenizer())), rows(odd_docs))


def test_token_output_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_tokens(rows(tokenout.token_output(docs, tokenout.default_tokenizer())), rows(docs))


def test_token_output_of_nothing(no_docs):
    assert rows(tokenout.token_output(no_docs, tokenout.default_tokenizer())) == []


def test_encoder_forgets_and_agrees():
    from tokenizers import Tokenizer

    path = tokenout.default_tokenizer()
    whole, mine = Tokenizer.from_file(path), tokenout.TextEncoder(path, 2)
    texts = ["it's l'été, naïve. coöp 12 3.4", "", " x ", "ß ŒUVRE œuvre", "a.b.c ... ,,", "Σας ΣΑΣ", "İstanbul K"]
    for _ in range(2):
        ids, n = mine.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)


# --- language model ----------------------------------------------------------------------------
def test_forward_is_the_sum_over_paths():
    rng, k = np.random.default_rng(1), 3
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.SYMBOLS), k))
    texts = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 6, 3, 2)]
    for text, got in zip(texts, hmm.forward_log10(m, texts), strict=True):
        p = 0.0
        for z in itertools.product(range(k), repeat=len(text)):
            q = m.start[z[0]] * m.emit[z[0], text[0]]
            for i in range(1, len(text)):
                q *= m.move[z[i - 1], z[i]] * m.emit[z[i], text[i]]
            p += q
        assert abs(math.log10(p) - got) < 1e-9


def test_baum_welch_never_gets_worse():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 30, n).astype(np.uint16) for n in rng.integers(1, 80, 60)]
    unigram = np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS)
    model = hmm.Model(np.full(4, 0.25), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(hmm.SYMBOLS), 4))
    logs = []
    for _ in range(6):
        e = hmm.Expected(4)
        e.add(model, texts)
        logs.append(e.log)
        assert abs(e.emit.sum() - sum(map(len, texts))) < 1e-6
        model = e.model(unigram)
    assert logs[-1] > logs[1] and all(b > a - 1 for a, b in zip(logs[1:], logs[2:], strict=False))


def check_scores(found, docs):
    seq = [(d["doc_id"], [*words((d["text"] or "").translate(LOWER)), "\0"]) for d in docs]
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    c = collections.Counter(w for k, t in seq if not out(k) for w in t)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(k), out(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for k, t in seq)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = rows(hmm.score_texts(docs, states=4, passes=1))
    check_scores(found, rows(docs))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_odd_rows(odd_docs, no_docs):
    check_scores(rows(hmm.score_texts(odd_docs, states=2, passes=1)), rows(odd_docs))
    assert rows(hmm.score_texts(no_docs, states=2, passes=1)) == []


# --- sharding ----------------------------------------------------------------------------------
def check_shards(found, n):
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert len(found) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_sharding(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, odd_docs, no_docs):
        check_shards(rows(sharding.shard_documents(d)), d.count())


def test_sharding_keeps_groups_and_splits_the_hot_one(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, F.concat(F.lit("g"), (F.col("id") % 250).cast("string"))).otherwise(F.concat(F.lit("s"), "id")).alias("text"))
    found = rows(sharding.shard_documents(docs))
    check_shards(found, 3000)
    shards = collections.defaultdict(set)
    for r in found:
        if 1000 <= r["doc_id"] < 2000:
            shards[r["doc_id"] % 250].add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) > 200


# --- url filter --------------------------------------------------------------------------------
def test_rules(spark):
    urls = ["http://a.net/x", "http://EXAMPLE.net/en/1?q", "https://b.example.net/en/#t", "http://example.net/de/", "ftp://www.example.com/de/x", "http://notexample.com/de/x", "http://x.org/fr/", "http://x.org/frx", "http://a.net", "no scheme", None, "http://u:p@Z.ORG:80/fr/a"]
    pages = spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in rows(urlfilter.judge_urls(pages))}
    assert [got[k]["rule"] for k in range(len(urls))] == ["net/", "example.net/en/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[k]["host"] for k in (1, 9, 10, 11)] == ["example.net", "", "", "u:p@z.org:80"]
    assert got[4]["path"] == "/de/x" and got[1]["verdict"] == "allow" and got[3]["verdict"] == "block" and got[9]["verdict"] == "allow"


def test_rank_against_power_iteration(spark):
    rng = np.random.default_rng(3)
    names = [f"h{k}" for k in range(12)]
    links = {(a, b): int(rng.integers(1, 5)) for a in names for b in names if a != b and rng.random() < 0.25}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "a string, b string, links long")
    seeds = {"h0": 1.0, "h3": 0.5}
    got = {r["host"]: r["score"] for r in rows(urlfilter.personalised_rank(edges, spark.createDataFrame(list(seeds.items()), "host string, seed double"), steps=10))}
    s = np.array([seeds.get(n, 0) for n in names]) / 1.5
    m = np.array([[links.get((a, b), 0) for b in names] for a in names], float)
    m = np.divide(m, m.sum(axis=1, keepdims=True), where=m.sum(axis=1, keepdims=True) > 0, out=np.zeros_like(m))
    x = s.copy()
    for _ in range(10):
        y = 0.85 * x @ m
        x = y + (1 - y.sum()) * s
    assert all(abs(got.get(n, 0.0) - x[k]) < 1e-9 for k, n in enumerate(names))


def test_distrust_reaches_who_links_to_the_blocked(spark):
    pages = spark.createDataFrame(
        [(1, "http://spam.net/x", None), (2, "http://linker.com/a", '<a href="http://spam.net/x">'), (3, "http://good.org/fr/", "<a href='http://friend.com/'>"), (4, "http://friend.com/", None), (5, "http://alone.com/", "")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in rows(urlfilter.judge_urls(pages))}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


# --- mixing ------------------------------------------------------------------------------------
def check_mix(found, docs):
    source = collections.defaultdict(int)
    for d in docs:
        source[d["source"]] += len(words(d["text"]))
    names = sorted((s for s in source if s is not None)) + [None] * (None in source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, rest, target = dict(weight), 1.5 * sum(source.values()), {}
    while left:
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        full = [s for s in left if share[s] > 2 * source[s] + 1e-9]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * source[s]
            del left[s]
        rest = 1.5 * sum(source.values()) - sum(target.values())
    taken = collections.defaultdict(int)
    for r in found:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == source[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(1.0, 0.01 * target[s]) for s in source)


def test_mixing(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, odd_docs):
        check_mix(rows(mixing.mix_plan(d)), rows(d))
    assert rows(mixing.mix_plan(no_docs)) == []


def test_mixing_repeats_and_emits(spark, sf, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in rows(mixing.mix_plan(docs))}
    assert plan == {r["doc_id"]: r["taken"] for r in rows(mixing.mix_plan(docs.repartition(3)))}
    got = collections.Counter()
    for r in rows(mixing.mix(docs)):
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == {k: v for k, v in plan.items() if v}
    assert rows(mixing.mix(no_docs)) == []


# --- near duplicates ---------------------------------------------------------------------------
def brute_components(docs, width, least=80, of=100):
    sets = []
    for d in docs:
        w = words((d["text"] or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if docs[i]["doc_id"] is None or docs[j]["doc_id"] is None or not sets[i] or not sets[j]:
            continue
        c = len(sets[i] & sets[j])
        if docs[i]["doc_id"] == docs[j]["doc_id"] or of * c >= least * (len(sets[i]) + len(sets[j]) - c):
            parent[root(i)] = root(j)
    least_id = {}
    for k, d in enumerate(docs):
        if d["doc_id"] is not None:
            least_id[root(k)] = min(least_id.get(root(k), d["doc_id"]), d["doc_id"])
    return sorted((str(d["doc_id"]), len(sets[k]), str(least_id.get(root(k)) if d["doc_id"] is not None else None)) for k, d in enumerate(docs))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, sf, odd_docs, width):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        got = rows(neardup.near_duplicates(df, width=width))
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows(df), width)
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(no_docs):
    assert rows(neardup.near_duplicates(no_docs)) == []


def test_large_group_of_near_copies_with_small_blocks(spark, monkeypatch):
    """The exact finish finds what the pivots leave: no round but it."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(90):
        t = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 10))):
            t[at] = f"x{k}_{at}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = rows(neardup.near_duplicates(df, width=2))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows(df), 2)


# --- quality -----------------------------------------------------------------------------------
def brute_quality(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_measures(spark, sf, odd_docs):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        got = sorted(tuple(r) for r in quality.quality_rules(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted(brute_quality(r["text"]) for r in rows(df))


def test_quality_verdicts(spark, no_docs):
    good = "The boat is on the water and it was to be with the others for a while, as they had been at the pier.\n" * 1
    texts = {"good": good + "It is by the sea that we have the best of days.", "few_words": "too few", "symbols": " ".join(f"w{k}###" for k in range(40)) + " the and of", "repeated_windows": "a b c d e f g h " * 9}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["failed_rules"] for r in rows(quality.quality_rules(df))}
    assert got["good"] == [] and all(k in got[k] for k in ("few_words", "symbols", "repeated_windows"))
    assert [r["doc_id"] for r in rows(quality.passing(df))] == ["good"] and rows(quality.passing(no_docs)) == []


# --- licences ----------------------------------------------------------------------------------
def test_license_places(spark, sf, odd_docs):
    extra = spark.createDataFrame([(90, "CC BY cc-by all rights reserved ALL RIGHTS RESERVED"), (91, "released under the mit license. general public license"), (92, "cc"), (93, "reserved all rights")], "doc_id long, text string")
    for df in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd_docs.select("doc_id", "text"), extra):
        found = license.scan_licenses(df).select("text", "n_words", "base_places", "labels", "score").collect()
        for r in found:
            w = tokens(r["text"])
            expected = sorted((t.label, i) for t in license.BASE for i in range(len(w)) if w[i : i + len(t.words)] == t.words)
            assert r["n_words"] == len(w) and sorted((p["label"], p["start"]) for p in r["base_places"]) == expected
            assert {x for x, _ in expected} <= set(r["labels"]) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    got = {r["doc_id"]: r["labels"] for r in rows(license.scan_licenses(extra))}
    assert got[91] == ["gpl", "mit"] and got[92] == [] and got[93] == []


# --- quotes ------------------------------------------------------------------------------------
def test_quotes(spark):
    m = spark.createDataFrame(
        [(1, 0, "u", "Hello there\nhow are you?"), (1, 1, "a", "> Hello there\nfine"), (1, 2, "u", "other"), (1, 3, "a", "> how are YOU?\n> > x\nyes\n"), (2, 0, "u", "> other\nelsewhere"), (None, 0, "u", None), (2, 1, "u", "> unknown\n"), (3, 0, "u", "same"), (3, 0, "u", "same"), (3, None, "u", "first")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r["conv_id"], r["position"]): r for r in rows(quotes.link_quotes(m))}
    assert len(got) == 10
    assert (got[1, 1]["parent_position"], got[1, 1]["text"], got[1, 1]["depth"]) == (0, "fine", 1)
    assert (got[1, 3]["parent_position"], got[1, 3]["text"], got[1, 3]["quote_levels"], got[1, 3]["depth"]) == (0, "yes", 2, 1)
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_position"], got[2, 0]["depth"]) == (1, 2, 0)
    assert got[2, 1]["parent_position"] == 0 and got[3, 0]["text"] == "first" and got[3, 2]["depth"] == 2
    empty = spark.createDataFrame([], m.schema)
    assert rows(quotes.link_quotes(empty)) == []


# --- decontamination ---------------------------------------------------------------------------
def brute_leaks(docs, items):
    out = set()
    shingles = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for item in items:
        want = tokens(item["text"])
        n = min(5, len(want))
        if not want:
            continue
        f = shingles(want, n)
        for d in docs:
            w = tokens(d["text"])
            size = min(len(want), len(w))
            for at in range(len(w) - size + 1):
                c = shingles(w[at : at + size], n)
                whole = sum((c | f).values())
                if whole and sum((c & f).values()) / whole >= 0.8 - 1e-12:
                    out.add((d["doc_id"], item["item_id"]))
                    break
    return out


def test_leaks(spark, sf, odd_docs, no_docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(docs, bench))}
    items = rows(bench)
    hit = [d for d in rows(docs) if any(" ".join(tokens(i["text"])[:6]) in " ".join(tokens(d["text"])) or any(" ".join(tokens(i["text"])[k : k + 5]) in " ".join(tokens(d["text"])) for k in range(0, 10)) for i in items)]
    assert got == brute_leaks(hit, items) and got
    odd = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs along the river bank until it finds a place to sleep"), (2, "word"), (3, None), (4, ""), (None, "negative id here"), (5, "word")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(odd_docs, odd))}
    assert got == brute_leaks(rows(odd_docs), rows(odd))
    assert rows(decontam.find_leaks(no_docs, bench)) == [] and rows(decontam.find_leaks(odd_docs, odd.limit(0))) == []
    kept = {r["text"] for r in rows(decontam.decontaminate(odd_docs, odd))}
    assert "word" not in kept and "another text under a used id" in kept and None in kept


def test_op1_new_words_are_learnt_together():
    import sys

    import pyarrow as pa

    from fathomline.llm.tokenout import TextEncoder, default_tokenizer

    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzßéœÿà"))
    words = ["".join(rng.choice(letters, n)) + tail for n, tail in zip(rng.integers(1, 14, 4000), rng.choice(["", "", ".", ","], 4000))]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 4000, 40)] + ["Ünder 3.5 a.b, .. x, あ  z", "", None]
    encoder, calls = TextEncoder(default_tokenizer(), 2), []
    sys.setprofile(lambda _, event, __: calls.append(1) if event == "c_call" else None)
    try:
        ids, counts = encoder.encode(pa.array(texts))
    finally:
        sys.setprofile(None)
    want = [[*e.ids, 2] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    assert len(calls) < 2000  # one by one: several calls a word


def test_op2_counts_of_looked_up_words_are_added_in_place():
    rng = np.random.default_rng(6)
    states, looked = 3, 50_000
    emit = rng.random((states, hmm.SYMBOLS))
    model = hmm.Model(np.full(states, 1 / states), np.full((states, states), 1 / states), emit / emit.sum(axis=1, keepdims=True))
    codes = [np.concatenate([rng.integers(0, looked, n), looked + rng.integers(0, 20, 5)]) for n in (1, 40, 300)]
    symbols = [c % hmm.SYMBOLS for c in codes]
    whole, apart, table = hmm.Expected(states), hmm.Expected(states), np.zeros((looked, states))
    together = whole.add(model, symbols, codes, looked + 20)
    rest = apart.add(model, symbols, codes, 20, table)
    assert rest.shape == (20, states)
    assert np.allclose(np.concatenate([table, rest]), together) and math.isclose(table.sum() + rest.sum(), sum(map(len, codes)))
    assert np.allclose(whole.emit, apart.emit) and whole.log == apart.log


def test_op2_symbols_of_a_batch_take_four_bytes():
    rare = pa.array([[{"word": "qa", "n": 1, "k": 7}], [], [{"word": "qb", "n": 2, "k": 9}]])
    codes = pa.array([np.array(x, "<u4").tobytes() for x in ([0, 3, 2], [1, 2], [3, 3, 2])], pa.binary())
    got, symbols, _ = hmm._symbols(pa.RecordBatch.from_arrays([codes, rare], ["codes", "rare"]), np.array([0, 1, hmm.END]))
    assert [c.tolist() for c in got] == [[0, 3, 2], [1, 2], [4, 4, 2]]
    assert [x.tolist() for x in symbols] == [[0, hmm.OWN_SYMBOLS + 7, hmm.END], [1, hmm.END], [hmm.OWN_SYMBOLS + 9] * 2 + [hmm.END]]
    assert {x.dtype for x in (*got, *symbols)} == {np.dtype(np.int32)}


def test_op1_a_file_is_written_from_its_parts():
    import tracemalloc

    parts = [np.full(1 << 20, k, np.uint16) for k in range(8)]
    counts = np.full(8, 1 << 20)
    tracemalloc.start()
    sizes = [len(x) for x in tokenout.shard_parts(list(range(8)), counts, parts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20  # three copies before: 48 MB
    whole = tokenout.pack_shard(list(range(8)), counts, np.concatenate(parts))
    assert sum(sizes) == len(whole) and whole == b"".join(tokenout.shard_parts(list(range(8)), counts, parts))
    docs, ends, ids = tokenout.unpack_shard(whole)
    assert docs == list(range(8)) and ends.decode().tolist() == np.cumsum(counts).tolist() and ids.tolist() == np.concatenate(parts).tolist()


def test_op1_batches_of_bounded_rows(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    had, kept = spark.conf.get(key), tokenout.stored
    monkeypatch.setattr(tokenout, "stored", lambda df, label: seen.append(int(spark.conf.get(key))) or kept(df, label))
    docs = spark.range(2500).selectExpr("id AS doc_id", "repeat('ab ', 3) AS text")
    got = rows(tokenout.token_output(docs, tokenout.default_tokenizer()).drop("ids"))
    assert len(got) == 2500 and seen == [tokenout.BATCH_ROWS] and spark.conf.get(key) == had


def test_op1_an_encoder_outlives_its_task(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "'some words' AS text").repartition(8)
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        from fathomline.llm import tokenout as inside

        kept = inside.TextEncoder.__init__
        inside.TextEncoder.__init__ = lambda self, *a: (built.add(1), kept(self, *a))[1]
        try:
            yield from inner(batches)
        finally:
            inside.TextEncoder.__init__ = kept

    from fathomline.llm import common

    with pytest.MonkeyPatch.context() as patch:
        wrapped = []
        patch.setattr(tokenout, "arrow_map", lambda df, fn, schema: wrapped.append(fn) or common.arrow_map(df, count, schema))
        inner = lambda batches: wrapped[0](batches)
        manifest = tokenout.write_token_files(docs, tokenout.fresh_path(spark, "tokens"), tokenout.default_tokenizer(), 2, shards=48)
    assert sum(r.n_docs for r in manifest.collect()) == 64
    assert built.value <= 16  # one a task before, now one a worker


def test_op2_texts_are_scored_without_a_shuffle(odd_docs):
    df = hmm.score_texts(odd_docs, states=2, passes=1)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()  # encoded texts went through one


def test_op2_texts_side_by_side_and_alone(monkeypatch):
    rng = np.random.default_rng(5)
    k = 3
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.SYMBOLS), k))
    texts = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 2, 7, 8, 9, 31, 32, 33, 40, 5, 5)]
    words = [np.where(t % 5 == 0, -1, t % 7) for t in texts]
    alone = hmm.Expected(k)
    rows = sum(alone.add(model, [t], [w], 7) for t, w in zip(texts, words, strict=True))
    for block, held in ((1 << 15, 1 << 18), (11, 0), (88, 88), (33, 1 << 18)):
        monkeypatch.setattr(hmm, "BLOCK_TOKENS", block)
        monkeypatch.setattr(hmm, "HELD_TOKENS", held)
        together = hmm.Expected(k)
        got = together.add(model, texts, words, 7)
        for name in ("start", "move", "emit", "log"):
            assert np.allclose(getattr(together, name), getattr(alone, name), rtol=1e-9, atol=1e-12)
        assert np.allclose(got, rows) and np.isclose(got.sum(), sum((w >= 0).sum() for w in words))
    assert np.isclose(alone.log / np.log(10), hmm.forward_log10(model, texts).sum())


def test_op2_sums_of_sorted_rows():
    import pyarrow as pa

    def batch(names, words, rows):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(words, pa.string()), pa.array([0] * len(names), pa.int32()), pa.array(rows, pa.binary())], ["name", "word", "k", "e"])

    wide = lambda *x: np.array(x, "<f8").tobytes()
    slim = lambda *x: np.array(x, "<f4").tobytes()
    block = slim(*range(8))
    batches = [
        batch([-1, 0, 0, hmm.SYMBOLS], [None] * 4, [wide(1, 2), wide(1, 0), wide(0.5, 1), block]),
        batch([hmm.SYMBOLS, 0, 0], [None, "a", "a"], [block, slim(1, 0), slim(0, 1)]),
        batch([0, 0], ["a", "b"], [slim(2, 2), slim(1, 1)]),
    ]
    out = pa.Table.from_batches(hmm._summed(iter(batches))).to_pylist()
    got = [(r["name"], r["word"], np.frombuffer(r["e"], hmm._kind(r["e"], 2)).tolist()) for r in out]
    assert got == [(-1, None, [1, 2]), (0, None, [1.5, 1]), (hmm.SYMBOLS, None, [2.0 * x for x in range(8)]), (0, "a", [3, 3]), (0, "b", [1, 1])]
