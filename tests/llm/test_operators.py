"""Each operator against brute force on small tables with nulls, empties, long texts, copies and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halocline.llm import embed_dedup, exact_dedup, html_extract, langid, mixing, packing, secrets, simhash, token_counts, toxicity
from halocline.llm._common import attach_groups
from halocline.llm._components import connected_components, star_edges
from halocline.llm.queries import tokenizer_path

EN = "the cat and the dog went to the river because of the heat and they were not there when the rain came down"
DE = "der hund und die katze sind nicht in dem haus weil der regen auf das dach und in den garten gefallen ist"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _id int, u int"


def rows():
    long = " ".join(f"word{i} {EN}" for i in range(3000))
    varied = [f"n{i * i}" for i in range(200)]
    near = [*varied[:40], "changed", *varied[41:]]
    texts = [EN, EN, None, "", "  \n", "a", DE, long, " ".join(varied), " ".join(near), EN, "12345 !!", "İß ſ ﬁ <|endoftext|> it's", "é" * 50, None]
    return [(i, t, "de" if t == DE else "en" if t and "the" in t else None, "s0" if i % 3 else None, 0, None, 7, 8) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in rows()}


def test_exact_dedup(docs, none):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, carry={"h": F.lit(1)}).collect()}
    for i, t in texts().items():
        same = [j for j, o in texts().items() if o == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["h"]) == (max(same), len(same), i == max(same), 1)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(texts().values()))
    assert exact_dedup.exact_dedup(none).count() == 0
    # A prefix shared by different texts of one length still gets a full comparison.
    assert exact_dedup.exact_dedup(docs, prefix=1).where("group_size > 1").count() == sum(list(texts().values()).count(t) > 1 for t in texts().values())


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), length=64).collect()
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts())
    for i, own in by_doc.items():
        ids, at = np.array([*t.encode(texts()[i], add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 64
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_hilbert_curve_steps_by_one():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    path = cells[np.argsort(packing.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().translate(simhash.LOWER))
    s = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, none):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    fp = {i: brute_fingerprint(t, 4) for i, t in texts().items()}
    comp = {i: i for i in fp}
    for _ in fp:
        for a, b in itertools.combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                comp[a] = comp[b] = min(comp[a], comp[b])
    for i in fp:
        assert got[i]["fingerprint"] == f"{fp[i]:016x}" and got[i]["component_id"] == comp[i]
    kept = simhash.drop_near_duplicates(docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and 8 in ids and 9 not in ids and {0, 6, 7} <= ids
    assert simhash.simhash_groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, none, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "SET_ROWS", chunk)
    rng, body = np.random.default_rng(4), [" ", "", None, "one two", "One  two"]
    for i in range(12):
        base = [f"w{i}x{j}" for j in range(120)]
        body.append(" ".join(base))
        for _ in range(4):  # one to seven changed words: similarities from 0.5 to 0.95
            changed = list(base)
            for at in rng.choice(120, rng.integers(1, 8), replace=False):
                changed[at] = f"new{rng.integers(10**6)}"
            body.append(" ".join(changed))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(body)], "doc_id long, text string, component int, doc int")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, comp = [grams(t) for t in body], list(range(len(body)))
    for _ in range(8):
        for a, b in itertools.combinations(range(len(body)), 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == dict(enumerate(comp)) and 5 < len(set(comp)) < len(body)
    assert simhash.near_duplicate_groups(none).count() == 0


@pytest.mark.parametrize("words", [1, 3])
def test_gray_index_loses_no_link(words):
    rng = np.random.default_rng(words)
    x = rng.integers(0, 1 << 63, (400, words), dtype=np.uint64)
    x[200:] = x[:200]
    for i in range(200, 400):
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x[i, 0] ^= np.uint64(1 << int(b))
    group = np.sort(rng.integers(0, 3, 400))
    u, v = simhash.linked_stars(x, group, np.arange(400), 4, at_once=500)
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    a, b = np.nonzero((d <= 4) & (group[:, None] == group) & (np.arange(400)[:, None] < np.arange(400)))
    want = star_edges(np.arange(400), a, b)
    assert sorted(zip(u, v, strict=True)) == sorted(zip(*want, strict=True))


def brute_links(x, most):
    d = np.bitwise_count(x[:, None] ^ x[None])
    return {(i, j) for i, j in zip(*np.nonzero(d <= most), strict=True) if i < j}


@pytest.mark.parametrize(("n", "rows"), [(1, 2048), (3000, 64), (3000, 1)])
def test_ranges_bring_all_links_together(monkeypatch, n, rows):
    """Each linked pair meets in a range that both are sent to, with no more differing bits of the block than allowed."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "RANGE_ROWS", rows)
    rng = np.random.default_rng(0)
    blocks, most, prefix = simhash.gray_routes(n, 4)
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        x[1] = x[0]
        for bit in rng.choice(64, 4, replace=False):
            x[1] ^= np.uint64(1 << int(bit))
        batch = pa.RecordBatch.from_arrays([pa.array([v.astype(">u8").tobytes() for v in x], pa.binary()), pa.array([0, 1])], names=["fp", "rep"])
        sent = {0: set(), 1: set()}
        for out in simhash._ranges(blocks, most, prefix, [batch]):
            for r in out.to_pylist():
                sent[r["rep"]].add((r["route"], min(r["key"], r["other"]), max(r["key"], r["other"])))
        assert sent[0] & sent[1]


def test_gray_index_prunes_and_counts():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    x[2000:] = x[:2000]
    for i in range(2000, 4000):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            x[i] ^= np.uint64(1 << int(bit))
    found, tally = set(), simhash.Counter()
    blocks, most, _ = simhash.gray_routes(1, 4)
    for first, bits in blocks:
        turned = (x << np.uint64(first)) | (x >> np.uint64(64 - first)) if first else x
        u, v = simhash.linked_stars(turned[:, None], np.zeros(4000, dtype=np.int64), np.arange(4000), 4, (bits, most), tally=tally)
        found |= set(zip(u.tolist(), v.tolist(), strict=True))
    a, b = map(np.array, zip(*brute_links(x, 4), strict=True))
    got = simhash.label_min(4000, *map(np.array, zip(*found, strict=True)))
    assert np.array_equal(got, simhash.label_min(4000, a, b))
    # Of 8 million pairs, three times over, the tree compares few leaf by leaf; most nodes fall with all below them.
    assert tally["leaves"] < 0.06 * 3 * 4000 * 3999 / 2 and tally["pruned"] > 0.5 * tally["nodes"], tally


@pytest.mark.parametrize("chunk", [4096, 8])
def test_simhash_of_many_ranges_equals_brute_force(spark, monkeypatch, chunk):
    """Fingerprints are taken as given: words whose single shingle's hash is the fingerprint."""
    monkeypatch.setattr(simhash, "RANGE_ROWS", 16)
    monkeypatch.setattr(simhash, "ROUTE_ROWS", chunk)
    monkeypatch.setattr(simhash, "LONG_ROUTES", 10**9)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    body = []
    for i in range(150):
        words = [*base[: 40 + i % 5], *(f"own{i % 30}x{j}" for j in range(120))]
        for at in rng.choice(len(words), rng.integers(0, 3), replace=False):
            words[at] = f"new{rng.integers(10**6)}"
        body.append(" ".join(words))
    df = spark.createDataFrame([*enumerate(body), (None, body[0])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.simhash_groups(df).collect()}
    fp = np.array([int(got[i]["fingerprint"], 16) for i in range(len(body))], dtype=np.uint64)
    a, b = map(np.array, zip(*brute_links(fp, 4), strict=True))
    want = simhash.label_min(len(body), a, b)
    assert [got[i]["component_id"] for i in range(len(body))] == want.tolist() and len(set(want.tolist())) < 140
    assert got[None]["fingerprint"] == got[0]["fingerprint"] and got[None]["component_id"] is None


def test_components_of_long_paths(spark, monkeypatch):
    import halocline.llm._components as cc

    monkeypatch.setattr(cc, "ONE_TASK_EDGES", 0)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (130, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 300]}


def test_attach_groups(spark):
    r = spark.createDataFrame([(i, 0 if i < 900 else i) for i in range(2000)], "i long, k long")
    g = r.groupBy("k").agg(F.count("*").alias("n"))
    assert attach_groups(r, g, ["k"], "n", 2000).where("n = 900 or n = 1").count() == 2000


def test_mixing(docs, none):
    got = mixing.mix(docs, block_chars=64).collect()
    assert {r["doc_id"] for r in got} == set(texts()) and len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    mixed = mixing.mixed_documents(docs, block_chars=64)
    assert mixed.columns == docs.columns and mixed.count() == len(got)
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1.0})


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 5.0, "b": 1.0, "c": 0.01}, {str(i): i + 1.0 for i in range(40)}])
def test_pfair_lag_is_below_one_block(weights):
    shares = mixing.whole_shares(weights, 512)
    plan, done = mixing.pfair_period(shares), dict.fromkeys(shares, 0)
    for t, (k, i) in enumerate(plan, 1):
        assert i == done[k]
        done[k] += 1
        assert all(abs(done[s] - t * shares[s] / 512) < 1 for s in shares)
    assert done == shares


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    n = np.array([len(t.encode(x, add_special_tokens=False).ids) for x in texts().values()])
    out = token_counts.token_counts(docs, tokenizer_path())
    for r in out.collect():
        assert r["n_docs"] == (n == r["n_tokens"]).sum() and r["tokens_at_least"] == n[n >= r["n_tokens"]].sum()
        assert r["truncated_tokens"] == np.minimum(n, r["n_tokens"]).sum() and r["quantile"] == pytest.approx((n <= r["n_tokens"]).mean())
    assert token_counts.truncated_total(out, 10) == np.minimum(n, 10).sum()
    assert token_counts.token_counts(none, tokenizer_path()).count() == 0


def test_secrets(spark, none):
    key = hashlib.sha512(b"x").hexdigest()
    import base64

    random = base64.b64encode(hashlib.sha512(b"y").digest()).decode().rstrip("=").replace("+", "A").replace("/", "b")
    body = ['Password = "hunter22" é𝄞', "token:token:abcdefgh", "api_key=abc", "AKIA" + "A1" * 8, "AKIA123", f"x {key[:30]} y", "deadbeef", None, "", f"noise {random} end", f"{EN} " * 50 + "secret: Zz9._=+-/x"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(body)], "doc_id long, text string, base int")
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.scan(df).collect():
        t = body[r["doc_id"]] or ""
        want = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in r["base"]] == sorted(want)
        if r["doc_id"] == 9:
            assert [(s["start"], s["end"]) for s in r["random"]] == [(6, 6 + len(random))]
        else:
            assert not r["random"]
    assert secrets.scan(none).count() == 0


def test_secrets_null_counts_every_row(spark, monkeypatch):
    body = [None, "", "\u00e9", "a b", "x" * 20, f"{'y' * 19}\u00e9zz"] + [f"{EN} w{i:x}-{i % 97} {'Q' * 25}\t{i * i}+/_" for i in range(4000)]
    want = collections.Counter(w[k : k + 2] for t in body for w in re.findall("[A-Za-z0-9+/_-]+", t or "") if len(w) < 20 for k in range(len(w) - 1))
    seen, costs = [], secrets.null_costs
    monkeypatch.setattr(secrets, "null_costs", lambda pairs: costs(seen.append(pairs) or pairs))
    secrets.scan(spark.createDataFrame(list(enumerate(body)), "doc_id long, text string"))
    assert seen == [want]


def test_language(docs, none):
    profiles = langid.learn_profiles(docs)
    assert profiles.langs == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(docs, profiles).collect()}
    assert got[0]["lang_pred"] == "en" and got[6]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known_languages(docs, profiles)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(texts()) - {2, 3, 4, 11, 14}
    empty = langid.learn_profiles(none)
    assert langid.identify(docs, empty).where("lang_pred <> 'und'").count() == 0 and langid.identify(none, empty).count() == 0


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = (EN + " Ä🎵 ") * 20
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    cut = langid.ngram_counts(text)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    make = lambda bad: " ".join([*rng.choice(words, 30), *(["zonkface", "blarghead"] if bad else [])])
    data = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], 0, x[2]) for x in data if x[0] < 300], "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in data)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    blank = toxicity.learn(none, labels)
    assert toxicity.score_toxicity(docs, blank).where("score <> 0").count() == 0 and toxicity.score_toxicity(none, blank).count() == 0


def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Home</a></nav><header>Top</header><div class='cookie-notice'>ok?</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two</b>\n three<p>Four<br>five &lt;x<div class=ad>buy</div><ul><li>i<li>j</ul><section class='comments'><p>nice</p></section><form>f</form></article><aside>side</aside><footer>&copy;</footer>"
    want = "Head & more\nOne two three\nFour five <x\ni\nj"
    plain = [f"<div class=top>Same words on all</div><div class=main><p>Story {i} is told</p><p>and ends {i * 7}</p></div>" for i in range(12)]
    rows_ = [(0, "http://a.com/x", page), (1, None, None), (2, "bad", ""), (3, "http://c.com", "a < b <unclosed")] + [(10 + i, "http://b.com/" + str(i), p) for i, p in enumerate(plain)]
    df = spark.createDataFrame([(*r, 5) for r in rows_], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "a < b"
    assert all(got[10 + i]["text"] == f"Story {i} is told\nand ends {i * 7}" for i in range(12))
    assert html_extract.extract(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize(("kind", "many"), [("float", 20_000), ("double", 10**9)])
def test_vectors(spark, monkeypatch, kind, many):
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", 16)
    monkeypatch.setattr(embed_dedup, "LONG_LISTS", many)
    monkeypatch.setattr(embed_dedup, "FEWER", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    x = [*(base[i % 30] + rng.normal(scale=0.06, size=8) for i in range(150)), *base[:5], *(base[:5] * 3)]
    data = [(i, v.astype(np.float32).tolist(), i % 2 if i < 150 else 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [None, *[1.0] * 7], 0), (904, base[0].tolist(), None), (905, [float("inf")] * 8, 0), (906, [], 0), (907, [1.0, 0.0], 0), (908, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in data + odd], f"vec_id long, embedding array<{kind}>, label int, n int")
    good = [r for r in data + odd[-2:]]
    comp, links = {r[0]: r[0] for r in data + odd}, {r[0]: 0 for r in data + odd}
    pairs = []
    for a, b in itertools.combinations(good, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            u, v = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
            if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98:
                pairs.append((a[0], b[0]))
    for _ in range(30):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    for p in pairs:
        for i in p:
            links[i] += 1
    assert pairs
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == links and {i: r["component_id"] for i, r in got.items()} == comp
    assert embed_dedup.near_duplicate_vectors(df.where("vec_id < 0")).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    for given in (docs, none):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "unused")
            out.write.parquet(f"{tmp_path}/{given.count()}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{given.count()}-{name}")
            if name != "pack_sequences":
                assert now.columns == given.columns
    assert corpus_pipeline.ORACLE_SQL is None


#: Alphabet and lengths of planted secrets; lower-case hex of 24 letters or more is a kind of its own.
PLANTED = {
    "hex": ("0123456789abcdef", (20,)),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (20, 32, 40, 64)),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", (20, 32, 40, 64)),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (20, 32, 40, 64)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (20, 32, 40, 64)),
}


def random_recall(spark, planted):
    """(share found of each kind and length, ordinary runs found) among nine ordinary runs for each secret."""
    rng, body, where = np.random.default_rng(6), [], []
    words = f"{EN} {DE} customer order request handler configuration default response value".split()
    for kind, (letters, lengths) in planted.items():
        for n in lengths:
            for _ in range(25):
                secret = "".join(rng.choice(list(letters), n))
                body.append(f"{EN} {secret} {DE}")
                where.append((kind, n, len(EN) + 1, len(EN) + 1 + n))
    for _ in range(9 * len(where)):
        own = [str(w) for w in rng.choice(words, 7)]
        join = rng.integers(4)
        run = "".join(w.title() for w in own) if join == 3 else "_-/"[join].join(own) + f"-{rng.integers(2030)}"
        body.append(f"{EN} {run} {DE}")
    df = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["random"]] for r in secrets.scan(df).collect()}
    found = {}
    for i, (kind, n, start, end) in enumerate(where):
        found.setdefault((kind, n), []).append((start, end) in got[i])
    return {k: sum(v) / len(v) for k, v in found.items()}, sum(bool(got[i]) for i in range(len(where), len(body)))


def test_planted_secrets_of_usual_length_are_found(spark):
    found, wrong = random_recall(spark, PLANTED)
    assert min(found.values()) >= 0.9 and np.mean(list(found.values())) >= 0.98, found
    assert wrong <= 4


def test_secrets_of_every_alphabet_are_tested(spark):
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    forms = {"HEX": digits + "ABCDEF", "BASE36": digits + upper, "lower-": digits + lower + "_-", "UPPER-": digits + upper + "_-"}
    found, wrong = random_recall(spark, {k: (v, (20, 32, 40, 64)) for k, v in forms.items()})
    assert min(found.values()) >= 0.9 and np.mean(list(found.values())) >= 0.98, found
    assert wrong <= 4


def test_html_words_of_wrappers_and_ids_lose_no_article():
    story = "<h1>Title</h1><p>A story that is long enough to be the most of its page, told in one paragraph.</p>"
    want = ["Title", "A story that is long enough to be the most of its page, told in one paragraph."]
    text = html_extract.article_blocks
    for mark in ("class='has-sidebar'", "class='content-with-sidebar'", "class='entry-header'", "id='related-work'", "class='search'"):
        assert text(f"<body><div {mark}>{story}</div><div class='sidebar'>Side</div><div class='cookie-banner'>Ok?</div>") == want
    assert text(f"<body><div>{story}</div><h2 id='cookie-recipes'>Recipes</h2><section id='social-networks'><p>More</p></section>") == [*want, "Recipes", "More"]
    teasers = "<article>One</article><article>Two</article>"
    assert set(want) <= set(text(f"<body><div>{story}</div>{teasers}"))
    assert text(f"<body><div>{story}</div><div class='comments'>" + "<div class='comment'>Nice one, thanks for it.</div>" * 9 + "</div>") == want


def test_near_duplicates_of_few_words_are_found(spark):
    body = []
    for i in range(60):  # four of five shingles, and five of six
        for n in (8, 9):
            words = [f"w{i}x{n}x{j}" for j in range(n)]
            body += [" ".join(words), " ".join([*words, "more"])]
    df = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(body))}
    assert simhash.worst_flip_rate(0.8, 3) > 0.18 > simhash.worst_flip_rate(0.8, simhash.FEW) >= simhash.flip_rate(0.8)


def test_symbols_above_the_first_plane_are_no_letters():
    profiles = langid.Profiles({"en": langid.ranked(*langid.ngram_counts(EN), 400)})
    assert profiles.predict("🎵 😀😀 🚀")[0] == "und" and profiles.predict("𠀀𠀁 🎵")[0] == "en"


def test_mixing_keeps_weights_of_many_sources(spark):
    weights = {"hot": 1e10**0.9} | {f"big{i}": 2e9**0.9 for i in range(10)} | {f"small{i}": 1e4**0.9 for i in range(8000)}
    period = mixing.fine_period(weights, mixing.PERIOD)
    shares, total = mixing.whole_shares(weights, period), sum(weights.values())
    assert all(abs(shares[k] / period / (w / total) - 1) < 0.05 for k, w in weights.items())
    # More sources than the least period has slots: an error before.
    body = [(i, "x" * 99, "hot") for i in range(2000)] + [(5000 + i, "x" * 99, f"s{i}") for i in range(30)]
    df = spark.createDataFrame(body, "doc_id long, text string, source string")
    wanted = {"hot": 0.97} | {f"s{i}": 0.001 for i in range(30)}
    got = mixing.mix(df, wanted, block_chars=100, period=8).collect()
    assert {r["doc_id"] for r in got} == {b[0] for b in body} and len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    hot = sum(r["chars"] for r in got if r["source"] == "hot")
    assert abs(hot / sum(r["chars"] for r in got) - 0.97) < 0.01 and len(got) == len({r["slot"] for r in got})
