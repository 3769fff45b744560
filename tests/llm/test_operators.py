"""The training-data operators against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fieldweave.llm import binary_output, bsi_search, chat_format, lattice_lm, mixing, near_dedup, packing, quality_rules, toxicity, url_filter  # noqa: E402
from fieldweave.llm.common import Scratch  # noqa: E402
from fieldweave.llm.components import connected_components  # noqa: E402
from fieldweave.llm.tokens import encoder  # noqa: E402

SPACES = " \t\n\x0b\x0c\r"
LONG = ("lorem ipsum dolor sit amet " * 4000).strip()
TEXTS = [None, "", " \n ", "one two three", "One two\tthree", LONG, LONG + " tail", "ärger über ß", "a  b \n\n c", "same words here and there again", "same words here and there again"]


def words(text):
    for c in SPACES:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", None if i % 4 == 3 else f"s{i % 3}", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, size int, h string")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, a null id, a repeated row, and columns whose names operators use themselves."""
    df = table(spark, TEXTS)
    extra = df.where("doc_id = 9").union(df.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    return df.union(extra).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ["x"]).where("false")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 ------------------------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    out = {}
    for qi, q in queries:
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi))
        out[qi] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def found_top(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(out)


def test_search(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in raw]
    want = brute_top(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    assert found_top(bsi_search.query(spark, sf_dir)) == want


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(bsi_search, "BLOCK_ROWS", 7)
    g = np.random.default_rng(0)
    rows = [(i, [float(x) for x in g.integers(-2, 3, 6) / 256]) for i in range(40)]  # many ties
    rows += [(40, None), (41, [float("nan")] * 6), (42, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (43, [float("inf")] * 6), (44, [5.0, -3.0]), (45, []), (None, [1.0])]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "vec_id long, embedding array<double>, block int")
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert found_top(bsi_search.top_k(df, df.where("vec_id % 4 = 0"), 5)) == brute_top(good, [v for v in good if v[0] % 4 == 0], 5)
    few = df.where("vec_id < 3")
    assert found_top(bsi_search.top_k(few, few, 5)) == brute_top(good[:3], good[:3], 5)
    assert bsi_search.top_k(df.where("false"), df, 5).count() == 0
    twice = df.where("vec_id < 4").union(df.where("vec_id = 1"))
    assert bsi_search.top_k(twice, twice.where("vec_id = 1"), 5).count() == 3


# 2 ------------------------------------------------------------------------------------------------------------


def test_chat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    text = "\\### Assistant: </turn> ok"
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-7] = [(0, "user", text), (1, "assistant", text)]
    got = as_dict(chat_format.query(spark, sf_dir), "conv_id")
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat_format.format_turn(r, [{"type": "text", "text": t}])[0]) for _, r, t in turns)


def test_chat_parts():
    parts = [{"type": "text", "text": "see <image:x:1> \\ </turn>\n"}, {"type": "image", "ref": "a<b>", "tokens": 9}, {"type": "audio", "ref": "c"}, {"type": "text", "text": "end"}, {"type": "document", "ref": "d", "tokens": 0}]
    segment, spans, attached, expanded = chat_format.format_turn("assistant", parts)
    assert expanded == 9 + 128 and [a["kind"] for a in attached] == ["image", "audio", "document"]
    assert "".join(chat_format.unescape(segment[s["start"] : s["end"]]) for s in spans) == parts[0]["text"] + "end"
    [(role, back)] = chat_format.parse(segment)
    assert role == "assistant" and [p["type"] for p in back] == [p["type"] for p in parts] and back[1]["ref"] == "a<b>"
    assert segment[attached[0]["start"] :].startswith("<image:")


def test_chat_edges(spark):
    rows = [(1, 1, None, None), (1, None, "user", "x"), (None, 0, "assistant", "</turn>"), (2, 0, "<a>", "y"), (2, 0, "<a>", "y"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = as_dict(chat_format.digests(chat_format.format_turns(df)), "conv_id")
    assert got[1].n_turns == 2 and got[2].n_turns == 2 and got[None].loss_chars == 7 and got[3].loss_chars == len(LONG)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nx\n\n\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"<a>\ny\n<a>\ny\n").hexdigest()
    assert chat_format.digests(chat_format.format_turns(df.where("false"))).count() == 0
    typed = df.limit(1).withColumn("parts", F.expr("array(named_struct('type', 'image', 'text', null, 'ref', 'r', 'tokens', 3))"))
    assert chat_format.format_turns(typed).first().expanded_tokens == 3
    plain = df.limit(1).withColumn("parts", F.lit("no parts"))
    assert chat_format.format_turns(plain).first().expanded_tokens == 0
    odd = "array(null, named_struct('type', 'video', 'text', 'a', 'ref', 'r', 'tokens', 3), named_struct('type', null, 'text', 'b<', 'ref', 'r', 'tokens', 3), named_struct('type', 'video', 'text', null, 'ref', 'r', 'tokens', 3))"
    row = chat_format.format_turns(df.where("conv_id = 3").withColumn("parts", F.expr(odd))).first()
    assert row.segment == "<turn:assistant>ab\\l</turn>\n" and row.attachments == [] and len(row.loss_spans) == 2


# 3 ------------------------------------------------------------------------------------------------------------


def base_counts(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + o for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def brute_ratio(rows, labels):
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def grams(text):
        e = [xxhash.xxh64_intdigest(x.encode(), 42) for w in words(text) for x in re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~]+", w)]

        def chain(a, b):  # a hash of two longs: the second seeded with the first's
            return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))

        return [signed(h) % quality_rules.BUCKETS for h in e + [chain(a, b) for a, b in zip(e, e[1:])]]

    all_grams = [(i, grams(t)) for i, t in rows]
    good = {i for i, q in labels if q == 1}
    raw = Counter(g for _, gs in all_grams for g in gs)
    target = Counter(g for i, gs in all_grams if i in good for g in gs)
    scale, s = sum(target.values()) / sum(raw.values()), quality_rules.SMOOTH
    r = {g: math.log((target[g] + s) / (raw[g] * scale + s)) for g in raw}
    return {i: sum(r[g] for g in gs) / max(1, len(gs)) for i, gs in all_grams}


def test_quality(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    llr = brute_ratio(rows, labels)
    got = as_dict(quality_rules.query(spark, sf_dir))
    assert len(got) == len(rows)
    for i, t in rows:
        g, want = got[i], base_counts(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want
        assert g.llr == pytest.approx(llr[i], abs=1e-9)
        assert g.kept == (not want[5] and llr[i] >= quality_rules.THRESHOLD)


def test_quality_edges(spark, odd, none, no_labels):
    got = quality_rules.quality_rules(odd, no_labels).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == base_counts(TEXTS[r.doc_id])
        assert r.llr == 0
    assert quality_rules.quality_rules(none, no_labels).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    odd = odd.withColumn("row_key", F.lit("x")).withColumn("k_own", F.lit(3))
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns and not [r for r in kept.collect() if len(words(r.text)) < 50]


# 4 ------------------------------------------------------------------------------------------------------------


def brute_components(rows, width):
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, sf_dir, docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = near_dedup.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicate_chains(spark, monkeypatch):
    """A large group whose members are linked only through others, larger than a block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    g = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        if i % 3 == 0:
            base = base.copy()
            base[int(g.integers(0, 120))] = f"n{i}"
        rows.append((i, " ".join(base + ([f"x{i}"] if i % 3 else []))))
    rows += [(200 + i, " ".join(f"q{i}_{k}" for k in range(60)) + " " + " ".join(f"shared{k}" for k in range(50))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 5, 80).collect()}
    assert got == want


def test_near_duplicate_edges(spark, odd, none):
    got = near_dedup.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    want = brute_components(list(enumerate(TEXTS)), 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert near_dedup.near_duplicates(none).count() == 0
    one = near_dedup.keep_one(odd, 4)
    assert one.columns == odd.columns and one.where("doc_id = 9").count() == 1 and one.where("doc_id = 10").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7), (60, 61), (61, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 75: 50, 100: 50, 60: 60, 61: 60}


# 5 ------------------------------------------------------------------------------------------------------------


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    path = rest[cut:]
    return low(rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def brute_mine(rows, support, confidence):
    """Association rules with up to three tokens, by counting."""
    from itertools import combinations

    n, count = len(rows), Counter()
    for items, verdict in rows:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                count[c, None] += 1
                count[c, verdict] += 1
    return {(c, v) for (c, v), m in count.items() if v and m >= math.ceil(support * n) and m / count[c, None] >= confidence}


def test_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = as_dict(url_filter.query(spark, sf_dir), "page_id")
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path = parts_of(r.url)
        g, rule = got[r.page_id], ruled(host, path)
        assert (g.host, g.path) == (host, path)
        assert (g.rule, g.verdict) == rule if rule else g.rule is None and g.verdict in ("allow", "block")


def test_url_rules_by_counting(spark):
    rows = [("http://a.spam.net/x/1", "block")] * 5 + [("http://b.spam.net/x/2", "block")] * 4 + [("http://c.good.net/x/3", "allow")] * 9 + [("http://spam.net/y", "allow")]
    df = spark.createDataFrame(rows, "url string, given string")
    host, path = url_filter.split_url(F.col("url"))
    df = df.select("given", host.alias("host"), path.alias("path")).withColumn("items", url_filter.tokens(F.col("host"), F.col("path"))).persist()
    mined, uses = url_filter.mine(df.where("given is not null"), 0.1, 0.9, least=1)
    every = brute_mine([(r["items"], r.given) for r in df.collect()], 0.1, 0.9)
    assert {(m[0], m[1]) for m in mined} <= every
    for items, verdict in every:  # each counted rule follows from a mined one
        assert any(set(m[0]) <= set(items) and m[1] == verdict for m in mined)
    index = url_filter.RuleIndex(mined, uses)
    for t, rules in index.under.items():
        assert all(uses[t] == min(uses[x] for x in r[0]) for r in rules)
    for r in df.collect():
        fits = [m for m in mined if set(m[0]) <= set(r["items"])]
        want = min(fits, key=lambda m: (-m[2], -m[3], m[1] != "block", m[0]))[1] if fits else None
        assert index.judge(r["items"]) == want


def test_url_edges(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.ORG/es/x?a#b", "x://example.org", "x://org/?q", "x://notorg/", "x://A.COM/de/#", "x://h\n/y z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    df = df.union(df.where("page_id = 3"))
    got = url_filter.url_verdicts(df).collect()
    assert len(got) == 10
    for r in got:
        host, path = parts_of(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule = ruled(host, path)
        assert rule is None or (r.rule, r.verdict) == rule
    assert url_filter.url_verdicts(df.where("false")).count() == 0


# 6 and 10 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_equal_whole_texts(docs, name, kind):
    e = encoder(public_tokenizers.path(name), kind)
    odd = [" ", "  a  b ", "a\n\nb c\t d", "it's  don't 12 3 ", "\x1c a \x1d b", "Straße ÀÉ ǅ ß İ Σς", "<|endoftext|> x <|startoftext|>y", "é é́  ́ a", "a　b", "a.b, c! ?x", "\r\n a \r b", "co-op's", "a\0b c", "x\ny z.\nQ"]
    for t in odd + [r.text for r in docs.limit(80).collect()]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def token_ids(text, name):
    e = encoder(public_tokenizers.path(name), "byte").tokenizer if name.startswith("byte") else encoder(public_tokenizers.path(name), "word").tokenizer
    return e.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_id_shards(spark, sf_dir, docs):
    start, got = 0, as_dict(binary_output.query(spark, sf_dir))
    for r in docs.orderBy("doc_id").collect():
        ids = token_ids(r.text, "byte_bpe_50k.json")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == docs.count()


def test_id_shard_edges(spark, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = binary_output.read_shards(binary_output.write_shards(odd, f"file://{tmp_path}/a", path)).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    for r in rows[1:]:
        assert r.ids_crc32 == crc(token_ids(TEXTS[r.doc_id], "byte_bpe_50k.json"))
    assert binary_output.read_shards(binary_output.write_shards(none, f"file://{tmp_path}/b", path)).count() == 0
    one = binary_output.Shard(binary_output.write_shards(odd.coalesce(1), f"file://{tmp_path}/c", path).first().path)
    for i, (_, _, ids) in enumerate(one.documents(most=3)):
        assert np.array_equal(one.ids(i), ids)


def test_elias_fano():
    g = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (1000, 10), (3000, 10**9), (700, 10**12), (9001, 10**7)):
        v = np.sort(g.integers(0, top, n))
        e = binary_output.EliasFano.from_bytes(binary_output.EliasFano.encode(v).to_bytes())
        assert np.array_equal(e.window(0, n), v) and np.array_equal(e.window(n // 3, n // 2), v[n // 3 : n // 2])
        assert [e.select(i) for i in range(0, n, max(1, n // 50))] == v[:: max(1, n // 50)].tolist()
        assert len(e.to_bytes()) <= 64 + n * (3 + max(0, math.log2(top / n))) / 8 + n / 64


def check_packing(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts:
        ids = token_ids(t, "word_bpe_49k.json")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length and r.ids_crc32 == crc(part)
            assert r.length == capacity or r is pieces[-1]
    total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
    return len(by_seq), -(-total // capacity)


def test_packing(spark, sf_dir, docs):
    rows = packing.query(spark, sf_dir).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    full = sum(r.length > 1024 for r in rows)
    assert used <= max(least * 1.05 + 2, full + 2)


def test_packing_edges(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    for capacity in (7, 64):
        check_packing(packing.pack(df, path, capacity).collect(), list(enumerate(TEXTS)), capacity)
    rows = packing.pack(odd, path, 64).collect()
    assert sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    g = np.random.default_rng(seed)
    lengths = np.clip(g.lognormal(3.5 + seed / 4, 1, 5000).astype(int), 1, 200)
    hist = np.bincount(lengths, minlength=201)
    bins = packing.plan(hist, 200, n_groups=40)
    back = np.zeros(201, int)
    for b in bins:
        assert sum(n * k for n, k in b.content) == 200 - b.free >= 0
        for n, k in b.content:
            back[n] += k * b.count
    assert np.array_equal(back, hist)
    assert sum(b.count for b in bins) <= 1.06 * max(-(-int(lengths.sum()) // 200), int((lengths > 100).sum())) + 2


# 7 ------------------------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    names = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "bab", *[f"<0x{b:02X}>" for b in range(256)], ""]
    g = np.random.default_rng(2)
    logp = np.log(g.dirichlet(np.ones(len(names)))).tolist()
    lattice = lattice_lm.Lattice(names, logp)
    known = dict(zip(names[:8], logp))

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(known[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in known)
        if s[0] not in known:
            out += math.exp(sum(logp[8 + b] for b in s[0].encode())) * total(s[1:])
        return out

    sample = ["abab", "a", "", "bbaab", "zab", "aéb", "ab" * 40]
    got = lattice.forward(sample)
    for w, x in zip(sample, got):
        assert x == pytest.approx(math.log(total("▁" + w)) if w and len(w) < 20 else x)
    assert got[2] == logp[-1]
    both = np.zeros(len(names))
    lattice.forward(["ab" * 40], np.ones(1), both)
    assert both[:8].sum() > 0 and lattice._alike(["ab" * 40], None, None)[0] == pytest.approx(got[6])
    # Expected counts are the derivatives of the log probability.
    x = np.zeros(len(names))
    lattice.forward(["abab", "zab"], np.array([2.0, 1.0]), x)
    for p in (0, 3, 5, 8 + ord("z")):
        up = logp.copy()
        up[p] += 1e-6
        other = lattice_lm.Lattice(names, up).forward(["abab", "zab"])
        base = lattice.forward(["abab", "zab"])
        assert x[p] == pytest.approx(((other - base) * [2, 1]).sum() / 1e-6, abs=1e-4)


def brute_base(rows):
    tokens = {i: [*words(low(t)), ""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def test_lattice_scores(spark, sf_dir, docs):
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    got = as_dict(lattice_lm.query(spark, sf_dir))
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, n, known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score < 0


def test_lattice_join_equals_lookup(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b = (as_dict(lattice_lm.lattice_scores(docs.limit(60), path, frequent=n)) for n in (100_000, 3))
    for i in a:
        assert a[i].score == pytest.approx(b[i].score, rel=1e-9) and a[i].n_known == b[i].n_known


def test_lattice_score_by_all_segmentations(spark, monkeypatch):
    """The score of a text is the product, over its tokens, of the sum over all ways to spell the token."""
    monkeypatch.setattr(lattice_lm, "ROUNDS", 0)
    path = public_tokenizers.path("piece_bpe_32k.model")
    names, logp = lattice_lm.load_pieces(path)
    known, spell = dict(zip(names[:-257], logp)), logp[-257:-1]

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(known[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in known)
        return out if s[0] in known else out + math.exp(sum(spell[b] for b in s[0].encode())) * total(s[1:])

    texts = ["The cat", "thanea \u1e9e zebra THE", "", "  a\tb\nc "]
    got = as_dict(lattice_lm.lattice_scores(table(spark, texts), path, frequent=3))
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx((logp[-1] + sum(math.log(total("▁" + low(w))) for w in words(t))) / math.log(10), rel=1e-9)


def test_lattice_of_any_vocabulary():
    """Vocabularies of any size find all their pieces; a very long word gives the same by both passes."""
    g = np.random.default_rng(4)
    pieces = sorted({"".join(map(chr, g.integers(97, 123, int(k)))) for k in g.integers(1, 9, 120_000)})
    names = [*pieces, *[f"<0x{b:02X}>" for b in range(256)], ""]
    lattice = lattice_lm.Lattice(names, [math.log(1 / len(names))] * len(names))
    for p in pieces[::500]:
        assert lattice._one([p], None, None)[0] == pytest.approx(lattice._alike([p], None, None)[0])
    word = "ab" * 60_000
    x = np.zeros(len(names))
    assert math.isfinite(lattice.forward([word], np.ones(1), x)[0]) and x.sum() > 10_000


def test_lattice_edges(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice_lm.lattice_scores(odd.withColumnRenamed("size", "row"), path).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[0] == 1
    assert lattice_lm.lattice_scores(none, path).count() == 0
    only = odd.where("doc_id = 2").union(table(spark, ["abc"], 9))
    held = [r for r in only.collect() if not lattice_lm.is_held_out(r.doc_id)]
    assert all(r.train_tokens == sum(len(words(h.text)) + 1 for h in held) for r in lattice_lm.lattice_scores(only, path).collect())


# 8 ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def brute_mix(target, sizes):
    """Words that the golden ratio's first points give each source, and the sources in the order of their slots."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    total = sum(target.values())
    block = max(1, min(2048, int(total // 65536)))
    ends = np.cumsum([target[s] for s in names]) / max(total, 1e-300)
    points = (np.arange(int(total // block)) * ((math.sqrt(5) - 1) / 2)) % 1.0
    order = np.minimum(np.searchsorted(ends, points, side="right"), len(names) - 1)
    count = np.bincount(order, minlength=len(names))
    return {s: min(int(count[i]) * block, 2 * sizes[s]) for i, s in enumerate(names)}, [names[i] for i in order], block


def check_mix(df, got):
    rows = df.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    target = brute_targets(sizes)
    want, order, block = brute_mix(target, sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(target[g.source])
        assert 0 <= g.taken <= 2 * g["size"]
        taken[g.source] += g.taken
        for e in (1, 2):
            assert (g[f"slot_{e}"] is None) == (g[f"taken_{e}"] == 0)
            assert g[f"slot_{e}"] is None or order[g[f"slot_{e}"]] == g.source
    for s in sizes:
        assert taken[s] == want[s] and abs(taken[s] - target[s]) <= 3 * block + 1
    return taken


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    check_mix(docs, got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_edges(spark, odd, none):
    check_mix(odd, mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    one = odd.where("doc_id = 3")
    assert [r.taken for r in mixing.mix(one).collect()] == [4]
    assert [r.taken for r in mixing.mix(odd.where("doc_id = 0")).collect()] == [0]


def test_mixing_follows_its_points(spark, docs, monkeypatch):
    """Another sequence of points gives another mix."""
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = brute_mix(brute_targets(sizes), sizes)[0]
    for constant in (0.5, 0.1):
        monkeypatch.setattr(mixing, "GOLDEN", constant)
        taken = Counter()
        for r in mixing.mix(docs).collect():
            taken[r.source] += r.taken
        assert {s: taken[s] for s in sizes} != want


def test_mixed_documents_clashes(spark, odd):
    df = odd.drop("n_chars").withColumns({"m_own": F.lit("a"), "m_take": F.lit(1), "m_words": F.lit(None).cast("int"), "row": F.lit(2)})
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert {r.m_own for r in rows} == {"a"} and {r.m_take for r in rows} == {1}
    assert sum(len(words(r.text)) for r in rows) == sum(r.taken for r in mixing.mix(odd).collect())


def test_mixed_documents(spark, docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in got.items() if v} == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}


def test_schedule_is_even(spark, docs):
    scratch = Scratch(spark, "t")
    placed, _ = mixing.laid_out(docs, scratch)
    targets = mixing.source_targets(placed.select("source", "size")).persist()
    slots = mixing.schedule(targets, 64).collect()
    total = sum(r.target for r in targets.collect())
    for t in targets.collect():
        mine = sorted(r.slot for r in slots if r.source == t.source)
        for cut in (0.25, 0.5, 0.75):  # any prefix of the schedule holds the source's share
            n = cut * total / 64
            assert abs(sum(m < n for m in mine) - n * t.target / total) < 6
        assert abs(sum(r.words for r in slots if r.source == t.source) - t.target) <= 3 * 64


# 9 ------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = as_dict(toxicity.toxicity(docs, labels))
    assert len(got) == docs.count()
    hit, n = Counter(), Counter()
    for r in labels.collect():
        g = got.get(r.doc_id)
        assert g is None or g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if g and g.held_out:
            n[r.toxic] += 1
            hit[r.toxic] += g.predicted == r.toxic
    assert hit[1] >= 0.9 * n[1] and hit[0] >= 0.99 * n[0]
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())


def test_label_model_finds_accuracies():
    """Independent voters of known accuracy, and one that votes at random."""
    g = np.random.default_rng(3)
    y = g.random(20_000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.5])
    votes = np.where(g.random((len(y), 5)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = toxicity.LabelModel(patterns, counts.astype(float), 0.2)
    assert np.allclose(m.accuracy, right, atol=0.02) and m.correlation.shape == (5, 5)
    post = m.posterior(patterns)[inverse.ravel()]
    assert ((post > 0.5) == y).mean() > 0.95


def test_toxicity_edges(spark, odd, none, no_labels):
    got = toxicity.toxicity(odd, no_labels).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 for r in got)
    bad = table(spark, ["you idiot", "YOU IDIOT!!", "fine words"])
    assert [r.predicted for r in toxicity.toxicity(bad, no_labels).orderBy("doc_id").collect()] == [1, 1, 0]
    assert toxicity.toxicity(none, no_labels).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


# the pipeline -------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "mixing", "packing"]
    labels, now = spark.read.parquet(f"{sf_dir}/labels.parquet"), docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).persist()
        assert now.columns == docs.columns
        kept[name] = {r.doc_id for r in now.collect()}
    clean = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert kept["toxicity"] == clean
    assert kept["mixing"] <= kept["near_dedup"] <= kept["quality_rules"] <= kept["toxicity"]
    near = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept["quality_rules"]], 5)
    assert kept["near_dedup"] == {i for i, (_, c) in near.items() if i == c}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == kept["mixing"]
