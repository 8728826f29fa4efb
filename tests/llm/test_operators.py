"""The training-data operators against brute force, and on nulls, empty and repeated rows, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopframe.llm import fingerprints, html_extract, mixing, ngram_join, packing, quality_rules, sharding, suffix_dedup, token_files, toxicity

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.choice([3, 30, 120, 400])) for _ in range(30)]
    out = []
    for t in base:
        out.append(t)
        ws = t.split()
        for k in (1, 6):
            if len(ws) > 40:
                v = ws[:]
                for _ in range(k):
                    v[rng.randrange(len(v))] = rng.choice(words)
                out.append(" ".join(v))
    out += [base[3]] * 4 + [None, None, "", " \n\t", "one", "a b c d", "Line one\nLine one\nLine two", "x" * 5000, text(6000)]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), None, 5, None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated ids, and repeated rows."""
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "null id here and some more words", None, None, None, None, None), (None, None, None, None, None, None, None), (0, "another text under an id in use", "en", "s1", 1, 1, 1)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def ngram(df):
    own = F.when(F.col("id") != -(1 << 63), F.col("id"))
    return ngram_join.near_duplicates(df).select(own.alias("doc_id"), "n", "component")


@pytest.mark.parametrize("block,short,wide", [(ngram_join.BLOCK_SHINGLES, 6, 48), (200, 2, 48), (ngram_join.BLOCK_SHINGLES, 2, 0)])
def test_ngram_join(docs, rows, monkeypatch, block, short, wide):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "WIDE_LIST", wide)
    sets = shingle_sets([(r[0], r[1]) for r in rows])
    want = components(sets)
    assert {r["doc_id"]: (r["n"], r["component"]) for r in ngram(docs).collect()} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_ngram_join_odd(odd, none):
    got = ngram(odd).collect()
    assert len(got) == odd.count() and [r["component"] for r in got if r["doc_id"] is None] == [None, None]
    assert ngram(none).count() == 0
    kept = ngram_join.stage(None, odd, "")
    assert kept.columns == odd.columns and kept.filter("doc_id = 0").count() == 2 and kept.filter("doc_id IS NULL").count() == 2


def test_bitmaps_never_lose_a_link():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), np.int64).astype(np.uint64))
        keep = a[rng.random(len(a)) > 0.08]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 1 + len(a) // 8), np.int64).astype(np.uint64)]))
        if len(b):
            i = len(np.intersect1d(a, b))
            x, y = sorted((a, b), key=len)
            if 100 * i >= 80 * (len(a) + len(b) - i):
                assert ngram_join.may_link(len(x), ngram_join.bitmap(x), len(y), ngram_join.bitmap(y))


def test_wide_lists_connect_alike():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(6)
    new = lambda n: rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
    for _ in range(10):
        base = [new(rng.integers(20, 300)) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.3], new(rng.integers(1, 15))])) for b in (base[rng.integers(3)] for _ in range(40))]
        sets.sort(key=len)
        args = list(range(40)), [len(s) for s in sets], [ngram_join.bitmap(s) for s in sets]
        got = []
        for edges in (ngram_join.list_edges(*args, set()), ngram_join.wide_list_edges(*args)):
            root = list(range(40))
            for a, b in edges:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
            got.append(root)
        assert got[0] == got[1]


def test_block_search():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 600, np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:200][rng.random(200) > 0.05], base[rng.integers(0, 600, 15)]])) for _ in range(25)] + [np.unique(base[rng.integers(0, 600, 150)]) for _ in range(10)]
    block = ngram_join.Block(sets)
    for x in range(len(sets)):
        want = [y for y in range(len(sets)) if y != x and 100 * (k := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - k)]
        assert block.search(x).tolist() == want


def test_packing(docs, rows, odd, none):
    size = 64
    got = packing.pack_documents(docs, token_files.vocabulary("byte_bpe_50k.json"), 0, size, with_ids=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[d], key=lambda r: r["start"])
        assert [x for p in parts for x in p["ids"]] == ids and all(p["doc_tokens"] == len(ids) for p in parts)
        assert all(p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p["ids"])) for p in parts)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    # first-fit decreasing leaves at most one sequence of a group less than half full
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-2 * total // size) and total > 0.9 * size * len(bins)
    assert packing.pack_documents(odd, token_files.vocabulary("byte_bpe_50k.json"), 0).filter("start = 0").count() == odd.count()
    plain = Counter()
    for r in odd.select("doc_id", "text").collect():
        plain[r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1] += 1
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packing.pack_documents(odd, token_files.vocabulary("byte_bpe_50k.json"), 0).filter("start = 0").collect()) == plain
    assert packing.pack_documents(none, token_files.vocabulary("byte_bpe_50k.json"), 0).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(3)
    for _ in range(50):
        size, xs = 50, [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        room, want = [], [0] * len(xs)
        for k in sorted(range(len(xs)), key=lambda k: -xs[k]):
            b = next((i for i, r in enumerate(room) if r >= xs[k]), len(room))
            if b == len(room):
                room.append(size)
            room[b] -= xs[k]
            want[k] = b
        assert packing.first_fit_decreasing(xs, size)[0] == want


@pytest.mark.parametrize("name,word_spaces", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_tokens(rows, name, word_spaces, monkeypatch):
    from tokenizers import Tokenizer

    from hopframe.llm import token_cache

    texts = [r[1] for r in rows] + ["  a  b\n\n c ", "don't 's 'tis a's.b's", "x \x1f y\x85z", "é a .́b", "<|endoftext|> a", "日本 語。x ,  .", "\ta\t b", "a\xa0 b ß.ÀÉ,x²½", "Σας ΣΑΣ İx", ". a", "a\n. b", "a. . b", "5., b", "a., b.", "x!, y", "a  , b", ",", ", ", "..., . .\n, a", "'s, 5. 5.\n7. b", "\x01, a", "caf\u00e9, na\u00efve. \u00e0 \u00c0. e\u0301, I\u0307."]
    tok = Tokenizer.from_file(token_files.vocabulary(name))
    tok.encode_special_tokens = True
    want = [b"".join(x.to_bytes(4, "little") for x in tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for most in (token_cache.BATCH_CHARS, 300, 1):
        monkeypatch.setattr(token_cache, "BATCH_CHARS", most)
        monkeypatch.setattr(token_cache, "PART_CHARS", most // 2 or 1)
        cached, got = token_cache.CachedTokenizer(token_files.vocabulary(name), word_spaces), []
        for first, ids, at in cached.encode(pa.array(texts)):
            assert first == len(got)
            got += [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want


def test_token_files(spark, docs, rows, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary("word_bpe_49k.json"))
    tok.encode_special_tokens = True

    def write(df, name, each):
        path = str(tmp_path / name)
        token_files.write_token_files(df, path, token_files.vocabulary("word_bpe_49k.json"), 1, True, each)
        return path

    path = write(docs, "a", 10)
    got, at = {r["doc_id"]: r for r in token_files.read_token_files(spark, path).collect()}, 0
    for d, t, *_ in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    found = token_files.lookup(spark, path, [3])
    assert [r["doc_id"] for r in found.collect()] == [3] and "EqualTo(doc_id,3)], ReadSchema" in found._jdf.queryExecution().toString()
    # each file holds a range of ids of its own, so that statistics rule out all files but one, and has Bloom filters
    ranges = spark.read.orc(path).groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("a").collect()
    assert len(ranges) > 1 and all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:], strict=False))
    from pyarrow import orc

    for file in (tmp_path / "a").glob("*.orc"):
        data = orc.ORCFile(str(file))
        own = orc.read_table(str(file), columns=["doc_id"]).column(0).to_pylist()
        assert own == sorted(own) and data.compression == "ZSTD" and data.row_index_stride == 1000
    assert token_files.read_token_files(spark, write(odd, "b", 5)).count() == odd.count()
    assert token_files.read_token_files(spark, write(none, "c", 5)).count() == 0


def article(body):
    return f"<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article>{body}</article><footer>&copy; the end of the page</footer></body></html>"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), (article("<h1>T &lt;b&gt;</h1><p>a<b>b</b> c &amp;amp; 5 < 6"), "T <b> ab c &amp; 5 < 6"),
        (article("<p>x<script>var a='</p>';</script>y</p><style>p{}</style><!-- no <p>z</p> -->"), "xy"),
        (article("<p>first</p><div class='reader-comments'><p>this is the best of all the comments</p></div><form><p>name</p></form>last"), "first last"),
        (article("<p>one\n two\t three</p><br>four"), "one two three four"),
        ("<div id=sidebar><p>the menu of the site and all of it</p></div><p>" + "This is the text of the page and it is long enough to be of use. " * 5 + "</p><p>And short.</p>", ("This is the text of the page and it is long enough to be of use. " * 5).strip() + " And short."),
    ],
)
def test_html(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h1>Title</h1><p>See the <a>long link</a> here.</p><ul><li><a>one</a></li><li><a>two</a></li></ul></article>", "Title See the long link here."),
        ("<div><p>Short one here.</p><p>And short two.</p></div>", "Short one here. And short two."),
        (article("<p>a<p class='share-price'>b</p><div class=legal-history>c</div><div class='post-comments'>d</div>e"), "a b c e"),
        (article("<p class=notice>x<p>y"), "y"), ("<p>1 <2 x</p>", "1 <2 x"), ('<p title="a>b">c</p>', "c"), ("a < b and <c", "a < b and <c"),
        (article("<ul><li class=ad>x<li>y</ul><table><tr><td hidden>x<td>z</table>"), "y z"), (article("<b>b<i>c</b>d</i>"), "bcd"), (article("<svg><text>x</text></svg><p>y"), "y"),
    ],
)
def test_html_keeps_and_drops(page, text):
    assert html_extract.main_text(page) == text


def test_html_scanner_agrees_with_the_parser():
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out = []

        def handle_starttag(self, tag, attrs):
            self.out.append(("start", tag, {k: v or "" for k, v in attrs}))

        def handle_endtag(self, tag):
            self.out.append(("end", tag))

        def handle_data(self, data):
            if self.out and self.out[-1][0] == "text":
                self.out[-1] = ("text", self.out[-1][1] + data)
            else:
                self.out.append(("text", data))

    rng = random.Random(8)

    def inside(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(["p", "div", "span", "b", "ul", "section", "h2"])
            attrs = "".join(rng.choice([" class='x y'", ' id="a>b"', " data-x=1", " hidden", ' title="it\'s <b>"']) for _ in range(rng.randint(0, 2)))
            out += rng.choice(["text & more ", "<!-- <p>no</p> -->", "<br>", "<script>if (a < b) { '</p>' }</script>", f"<{name}{attrs}>{inside(depth - 1) if depth else 'x'}</{name}>"])
        return out

    for _ in range(300):
        page = "<!DOCTYPE html>" + inside(4)
        parser, want = Parser(), []
        parser.feed(page)
        parser.close()
        skip = False
        for t in parser.out:  # the scanner passes over the content and the end of raw elements
            if skip:
                skip = t != ("end", "script")
                continue
            want.append(t)
            skip = t[:2] == ("start", "script")
        got = [t[:3] for t in html_extract.Scanner(page).tokens()]
        joined = []
        for t in got:
            if joined and t[0] == joined[-1][0] == "text":
                joined[-1] = ("text", joined[-1][1] + t[1])
            else:
                joined.append(t)
        assert joined == [t for t in want if t != ("text", "")]


@pytest.mark.parametrize("unit", ['<a "', "<a b ", '<a b="', '<a b=">', "<a b='\">", "<div><p>", "<b><p></b>", "<li>", "</div", "<!--", "<script>", "<a href=x><li>"])
def test_html_is_linear(unit):
    import time

    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        html_extract.main_text(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_html_density_rules_alone(monkeypatch):
    """Without any hint of place, what the rules make of a page in plain divs."""
    monkeypatch.setattr(html_extract, "HINTS", set())
    monkeypatch.setattr(html_extract, "OUT", set())
    long_ = "This is the text of the page and it is long enough to be of use to all of us. "
    page = "<div><a href=a>Home</a> <a href=b>About</a></div>" + f"<div>{long_ * 3}</div><div>A short one.</div><div>{long_ * 4}</div>" + "<div><a href=c>Terms</a> | <a href=d>Privacy</a></div><div>Copyright 2020</div>"
    assert html_extract.main_text(page) == (long_ * 3).strip() + " A short one. " + (long_ * 4).strip()


def test_html_table(spark):
    rows = [(1, None, None), (1, "u", article("<p>é</p>")), (None, "u", "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()) == [("1", "", 0), ("1", "é", 1), ("None", "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_sharding(docs, rows, odd, none):
    got = sharding.shard_plan(docs).collect()
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {r[0]: (sizes[r[0]], zlib.crc32((r[1] or "").encode())) for r in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    ideal = sum(sizes.values()) / 8
    assert all(abs(load[k] - ideal) <= max(sizes.values()) + ideal * sharding.WHOLE_GROUP for k in range(8))
    assert sharding.shard_plan(odd).count() == odd.count() and sharding.shard_plan(none).count() == 0


def test_sharding_follows_the_curve(docs, rows):
    """Texts come in one order along the curve, cut into eight runs of near equal bytes; equal texts stay together."""
    got = sharding.shard_plan(docs).collect()
    shard = {r["doc_id"]: r["shard"] for r in got}
    by_text = defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(shard[r[0]])
    total = sum(r["size"] for r in got)
    size = {r["doc_id"]: r["size"] for r in got}
    for t, shards in by_text.items():
        if sum(size[r[0]] for r in rows if (r[1] or "") == t) <= sharding.WHOLE_GROUP * total / 8:
            assert len(shards) == 1
    assert set(shard.values()) <= set(range(8))


def test_hilbert_neighbours_touch(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("a"), F.floor(F.col("id") / 16).alias("b"))
    at = sorted((r["k"], r["a"], r["b"]) for r in sharding.hilbert(df, ["a", "b"], 4, "k").collect())
    assert [r[0] for r in at] == list(range(256))
    assert all(abs(x[1] - y[1]) + abs(x[2] - y[2]) == 1 for x, y in zip(at, at[1:], strict=False))


@pytest.fixture
def tiny_buckets(monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)


def test_fingerprints(docs, rows, odd, none, tiny_buckets):
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(docs).collect()}
    down = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    prints = defaultdict(set)
    for (d, t), (e, n) in zip(down, down[1:] + down[:1], strict=True):
        k = len(t) // 3
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        like = 1 - (int(r["fingerprint"], 16) ^ int(got[e]["fingerprint"], 16)).bit_count() / 128
        assert abs(r["near_next"] - like) < 1e-9
        prints[t].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.neighbour_fingerprints(none).count() == 0
    # null and repeated ids, repeated rows: the order is by falling id, then by a hash of the text, null ids last
    own = [(r[0], r[1] or "") for r in odd.select("doc_id", "text").collect()]
    own = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), (xx64([r[1]]) + (1 << 63)) % (1 << 64)))
    want = Counter()
    for (d, t), (_, n) in zip(own, own[1:] + own[:1], strict=True):
        want[d, hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.neighbour_fingerprints(odd.withColumnRenamed("rank", "place")).collect()) == want


def test_hamming_search(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(20)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(128), n))
    all_ = base + [flip(x, n) for x in base for n in (1, 9, 17, 22, 23, 24, 25, 26, 27, 30)]
    half = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, (half(x & (2**64 - 1)), half(x >> 64))) for i, x in enumerate(all_)], "key long, fp struct<a:long,b:long>")
    for radius in (6, 23, 26):
        got = [(r["query"], r["key"], r["distance"]) for r in fingerprints.search(df.filter("key < 20").withColumnRenamed("key", "query"), df, radius).collect()]
        want = {(i, j, d) for i in range(20) for j, y in enumerate(all_) if (d := (all_[i] ^ y).bit_count()) <= radius}
        assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        fingerprints.search(df, df, 27)


def xx64(parts, seed=42):
    """Spark's xxhash64 of some strings, the hash of one the seed of the next."""
    import xxhash

    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed


def simhash(text):
    """The fingerprint in plain Python."""
    import struct

    import xxhash

    ws = W.findall(text)
    terms = [xx64(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [xx64(ws)] if ws else []
    out = []
    for half in (lambda t: t, lambda t: xxhash.xxh64_intdigest(struct.pack("<i", 7), xxhash.xxh64_intdigest(struct.pack("<Q", t), 42))):
        bits, hashes = 0, [half(t) for t in terms]
        for k in range(64):
            if 2 * sum(h >> k & 1 for h in hashes) > len(terms):
                bits |= 1 << k
        out.append(bits)
    return f"{out[0]:016x}{out[1]:016x}"


def test_fingerprint_bits(docs, rows, tiny_buckets):
    down = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(docs).collect()}
    for (d, t), (_, n) in zip(down, down[1:] + down[:1], strict=True):
        k = len(t) // 3
        own, changed, following = simhash(t), simhash(t[: len(t) - k] + n[:k]), simhash(n)
        like = lambda x, y: 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 128
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed)
        assert abs(r["near_edited"] - like(own, changed)) < 1e-9 and abs(r["near_next"] - like(own, following)) < 1e-9


def test_fingerprint_search_of_documents(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "table", lambda *_: docs)
    got = {r["doc_id"]: r["n_near"] for r in fingerprints.op10(spark, "").collect()}
    prints = {r[0]: int(simhash(r[1] or ""), 16) for r in rows}
    want = {d: sum((x ^ y).bit_count() <= fingerprints.RADIUS for y in prints.values()) if d % 50 == 0 else None for d, x in prints.items()}
    assert got == want and any((n or 0) > 1 for n in want.values())


def test_near_copies_are_within_the_radius():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    found = total = 0
    for _ in range(60):
        a = [rng.choice(words) for _ in range(300)]
        b = a[:]
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(300)] = rng.choice(words)
        x, y = ({tuple(t[i : i + 5]) for i in range(296)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            found += (int(simhash(" ".join(a)), 16) ^ int(simhash(" ".join(b)), 16)).bit_count() <= fingerprints.RADIUS
    assert total > 30 and found >= 0.9 * total


def test_mixing(docs, rows, odd, none):
    got = {r["doc_id"]: r for r in mixing.mix(docs.withColumn("target", F.lit(1))).select("doc.doc_id", "source_size", F.col("target").alias("goal"), "taken").collect()}
    size = {r[0]: len(W.findall(r[1] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= 2 * total[s]
        free -= over
    taken = Counter()
    for r in rows:
        g = got[r[0]]
        assert g["source_size"] == total[r[3]] and abs(g["goal"] - target[r[3]]) < 1e-6 and g["taken"] in (0, size[r[0]], 2 * size[r[0]])
        taken[r[3]] += g["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[r[0]] for r in rows if r[3] == s)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.stage(None, docs, "").columns == docs.columns


def brute_removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cut[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out[d] = (len(b), sum(cut), sum(1 for i, c in enumerate(cut) if c and (not i or not cut[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_GROUP, 2])
def test_suffix_dedup(spark, docs, rows, odd, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUP", hot)

    def run(df):
        monkeypatch.setattr(suffix_dedup, "table", lambda *_: df)
        return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op5(spark, "").collect()}

    want = brute_removed([(r[0], r[1]) for r in rows])
    assert run(docs) == want and sum(x[1] for x in want.values()) > 1000
    if hot > 2:
        assert len(run(odd)) == len({r[0] for r in rows}) + 1 and run(none) == {}
        kept = suffix_dedup.stage(spark, docs, "")
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        # names that clash with the operator's own, where ids tell texts apart and where they don't
        for df in (docs, odd):
            clash = df.withColumns({c: F.lit(1) for c in ("_id", "_spans", "_text", "_th", "_doc", "_key", "rank")})
            kept = suffix_dedup.stage(spark, clash, "")
            assert kept.columns == clash.columns and kept.filter("_id = 1 AND _spans = 1 AND _text = 1 AND _th = 1 AND rank = 1").count() == kept.count() > 0


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(9)
    t = bytes(rng.choice(b"abc ") for _ in range(9000))
    whole = {(int(i), int(p - lo[np_at]) + int(b[np_at])) for i, p, lo, b, np_at in _places([t])}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2500)
    assert {(int(i), int(p - lo[k]) + int(b[k])) for i, p, lo, b, k in _places([t])} == whole


def _places(texts):
    import numpy as np

    for ids, begin, data, lo, hi, first, last in suffix_dedup.chunked(range(len(texts)), texts):
        place = suffix_dedup.anchors(data, lo, hi, first, last)[0]
        for p, k in zip(place, np.searchsorted(hi, place, side="right"), strict=True):
            yield ids[k], p, lo, begin, k


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(500):
        strs = [b"aaaaaaaaaaaa"[: rng.randint(0, 12)] + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 20]))) for _ in range(rng.randint(1, 12))]
        order, lcp = suffix_dedup.deep_shallow_sort(strs)
        got = [strs[k] for k in order]
        assert got == sorted(strs)
        for i in range(1, len(got)):
            c = 0
            while c < min(len(got[i - 1]), len(got[i])) and got[i - 1][c] == got[i][c]:
                c += 1
            assert lcp[i] == c


def test_toxicity(spark):
    rng = random.Random(2)
    plain = ["river", "stone", "cloud", "green", "table", "water", "paper", "light", "garden", "window", "mountain", "idle", "motor"]
    bad = {"idiot": ["1d10t", "i d i o t", "idiooot"], "moron": ["m0r0n", "m.o.r.o.n", "morooon"]}
    rows, labels = [], []
    for i in range(400):
        ws, toxic = [rng.choice(plain) for _ in range(30)], i % 4 == 0
        if toxic:
            ws[rng.randrange(30)] = rng.choice(list(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    hidden = [x for xs in bad.values() for x in xs]
    rows += [(1000 + k, " ".join([*(rng.choice(plain) for _ in range(20)), x, "river"])) for k, x in enumerate(hidden)] + [(2000, None), (2001, ""), (None, "stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert [got[1000 + k]["predicted"] for k in range(len(hidden))] == [1] * len(hidden)
    assert got[2000]["predicted"] == got[2001]["predicted"] == got[None]["predicted"] == 0
    for labels_ in (lab.limit(0), lab.filter("toxic = 0")):
        none_ = toxicity.learn(docs, labels_)
        assert none_.weights is None and {r["score"] for r in toxicity.score(docs, none_).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    # repeated rows, several texts and labels of one id, and other columns whatever their names
    again = docs.union(docs).withColumn("toxic", F.lit("x")).withColumn("words", F.lit(1)).withColumn("half", F.lit(1))
    model = toxicity.learn(again, lab.union(lab.withColumn("toxic", F.lit(0))))
    twice = toxicity.score(again, model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k"), F.max("predicted").alias("p")).collect()
    assert all((r["n"], r["k"]) == (2, 1) for r in twice) and all(r["p"] == int(r["doc_id"] % 4 == 0) for r in twice if r["doc_id"] is not None and r["doc_id"] < 400)


def test_viterbi_finds_the_best_reading():
    from itertools import product

    rng = random.Random(12)
    counts = Counter()
    for w in ["idiot", "moron", "river", "stone", "the", "garden", "motor", "idle", "trio"] * 5 + ["loop", "tool"]:
        counts.update(toxicity.trigram_index(w).tolist())
    restore = toxicity.Restorer(counts)
    for _ in range(150):
        token = "".join(rng.choice("idotmrn01@*!eе3") for _ in range(rng.randint(1, 8)))
        best = None
        for path in product(*restore.lattice(token)):
            s, x, y, text = 0.0, 0, 0, ""
            for read, cost in path:
                s += cost
                for c in read:
                    z = toxicity._CODE[c]
                    s, x, y = s + restore.log[x][y][z], y, z
                text += read
            s += restore.log[x][y][0]
            if best is None or s > best[0] + 1e-9:
                best, reads = (s, text), {text}
            elif abs(s - best[0]) <= 1e-9:
                reads.add(text)
        assert restore.decode(token) in reads


def test_disguises_of_any_length():
    counts = Counter()
    for w in ["idiot"] * 50 + ["river", "stone"] * 100:
        counts.update(toxicity.trigram_index(w).tolist())
    restore = toxicity.Restorer(counts)
    for text in ("i" * 70 + "d1ot", "ｉｄｉｏｔ", "ｉｄ１ｏｔ", "іdiоt", "i d i o t", "i.d.i.o.t", "1d!ot", "i\u200bdiot", "IDIOOOOT"):
        assert "idiot" in restore.words(text), text
    assert "idiot" in "".join(restore.words("x-" * 20_000 + "1d1ot"))
    assert restore.words("b a d")  # three letters set apart are read too
    assert restore.words(None) == restore.words("") == set()


def test_quality(docs, rows, odd, none):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for d, t, *_ in rows:
        w = W.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(none).count() == 0
    assert quality_rules.stage(None, odd, "").columns == odd.columns
    clash = odd.withColumns({c: F.lit(1) for c in ("_words", "_lines", "_windows", "_again", "_doc", "n_words")})
    judged = quality_rules.judge(clash)
    assert judged.columns[: len(odd.columns)] == odd.columns and judged.filter("_words = 1 AND _again = 1 AND _doc = 1").count() == odd.count()
    assert {(r["doc_id"], r["text"]): r["n_words"] for r in judged.collect()} == {(r["doc_id"], r["text"]): len(W.findall(r["text"] or "")) for r in odd.collect()}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert ids and ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    seqs = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] <= 1024 for r in seqs)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: the rows that stay, their texts, the mix and the packed ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    passage, texts = text(40), []
    for k in range(14):
        texts.append(text(rng.randint(80, 200)) + (" " + passage if k % 3 == 0 else "") + " " + text(20))
        if k % 4 == 0:
            ws = texts[-1].split()
            ws[len(ws) // 2] = "changed"
            texts += [" ".join(ws), texts[-1]]
    texts += [text(20), "\n".join(["the same line and no other here"] * 12), None, "# $ % & " * 40, text(70)]
    sources = [rng.choice(["s1", "s2", "s3", None]) for _ in texts]
    docs = spark.createDataFrame([(i, t, "en", c, len(t or "")) for i, (t, c) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            docs.write.parquet(str(tmp_path / f"{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}"))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got.append(docs.collect())
    stop = {w for line in quality_rules.STOP_WORDS for w in line.split()}

    def good(t):
        w = W.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            return False
        symbols, dup = len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        return 1.5 <= sum(map(len, w)) / len(w) <= 25 and symbols / len(w) <= 0.1 and sum(x.lower() in stop for x in w) / len(w) >= 0.01 and dup / len(lines) <= 0.3

    want = {i: t for i, t in enumerate(texts) if good(t)}
    assert {r["doc_id"]: r["text"] for r in got[0]} == want and 0 < len(want) < len(texts)
    group = components(shingle_sets(list(want.items())))
    alone = {i: t for i, t in want.items() if group[i] == i}
    assert {r["doc_id"]: r["text"] for r in got[1]} == alone and len(alone) < len(want)
    cut = brute_removed(list(alone.items()))
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in got[2]} == {i: c[3] for i, c in cut.items()} and any(c[1] for c in cut.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got[2])
    size = {r["doc_id"]: len(W.findall(r["text"])) for r in got[2]}
    times, total = Counter(r["doc_id"] for r in got[3]), sum(size.values())
    assert set(times) <= set(size) and max(times.values()) <= 2
    sources_ = len({r["source"] for r in got[2]})
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * total) <= sources_ * max(size.values())
    tok = Tokenizer.from_file(token_files.vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [0] for r in got[2]}
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got[4])
    assert pieces == Counter({(i, s, len(p := ids[i][s : s + 1024]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))): n for i, n in times.items() for s in range(0, len(ids[i]), 1024)})
    bins = defaultdict(list)
    for r in got[4]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
