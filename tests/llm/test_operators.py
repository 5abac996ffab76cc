"""Each training-data operator: odd rows have their documented results, and results match brute force."""

from __future__ import annotations

import hashlib
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import chat, embedding_join, exact_dedup, html_extract, ngram_join, packing, pieces, quality, shingles, token_file, tokens, warc
from siftline.operators.graph import connected_components

WORD = tokens.tokenizer_path("word_bpe_49k.json")
BYTE = tokens.tokenizer_path("byte_bpe_50k.json")
PIECE = tokens.tokenizer_path("piece_bpe_32k.model")
CLASHING = ("salt", "rank", "norm", "digest", "key", "rep", "n", "band", "cluster", "free", "x", "p", "id", "size")


def table(spark, rows, schema):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "Iota", "kappa"]
    prose = [" ".join(r.choice(words) for _ in range(n)) for n in (60, 60, 80, 300)]
    near = prose[3].split(" ")
    near[5] = "changed"
    rows = [
        (1, prose[0]), (2, prose[0]), (2, prose[0]), (3, prose[0].replace(" ", "\n")), (4, prose[1]), (5, ""), (6, None), (7, " \t\r\n\x0b\x0c"), (8, prose[2]), (9, "one two"),
        (10, "one TWO"), (11, prose[3]), (12, " ".join(near)), (13, "é日本 🙂 x" * 9000), (None, prose[1]), (14, "word" * 30000), (-5, prose[1] + " "), (15, "One two"),
    ]
    return table(spark, rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string")})


def library_ids(path, text, end):
    """The ids of a whole text by the library as it is, and the end id."""
    return np.asarray([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(docs):
    got = exact_dedup.exact_groups(docs).collect()
    data = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in data:
        groups.setdefault(t.translate(strip), []).append((-len(t), i is None, i))
    want = sorted((i, min(groups[t.translate(strip)])[2], len(groups[t.translate(strip)]), hashlib.sha256(t.translate(strip).encode()).hexdigest()) for i, t in data if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert len(got) == len(data)


def test_near_duplicates_match_brute_force(spark, docs):
    got = {}
    for r in ngram_join.near_duplicates(docs, words=4, num=85, den=100).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = {i: set(shingles.shingle_sets([t or ""], 4)[0].tolist()) for i, t in data}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i, s in sets.items():
        assert set(got[i]) == {(len(s), find(i))}
    assert got[None][0][1] is None


def test_signature_tree_finds_all_links():
    r = random.Random(1)
    for trial in range(12):
        base, sets = [r.getrandbits(63) for _ in range(r.choice([8, 60, 300]))], []
        for _ in range(r.randint(2, 150)):
            if r.random() < 0.15:
                base = [r.getrandbits(63) for _ in range(r.choice([1, 8, 60, 300]))]
            e = r.random() * 0.15
            sets.append(np.asarray(sorted({x if r.random() > e else r.getrandbits(63) for x in base}), np.uint64))
        plain = [set(s.tolist()) for s in sets]
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        bands = ngram_join._bands(85, 100)
        lows = np.asarray([b[0] for b in bands])
        keys = [set(ngram_join.block_keys(s, bands, lows, 85, 100).tolist()) for s in sets]
        needs = [ngram_join.shared_needs(s, bands, lows, 85, 100) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = len(plain[i] & plain[j])
                if 100 * both >= 85 * (len(plain[i]) + len(plain[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                    common = keys[i] & keys[j]
                    assert plain[i] == plain[j] or any(
                        sum(k % 2 == p for k in common) >= max(needs[i][p], needs[j][p]) for p in (0, 1) if p in needs[i] and p in needs[j]
                    )
        assert ngram_join.spanning_links(sets, 85, 100).tolist() == [find(i) for i in range(len(sets))], trial


def test_cluster_in_chunks(spark, monkeypatch):
    """A cluster beyond one chunk is compared chunk by chunk, with the same components."""
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(200)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(2):
            t[r.randrange(200)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(rows_of(ngram_join.near_duplicates(df)))
    monkeypatch.setattr(ngram_join, "CHUNK", 3000)
    assert sorted(rows_of(ngram_join.near_duplicates(df))) == whole


def test_components(spark):
    r = random.Random(2)
    for n in (0, 60, 200):
        edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(n)] + [(i, i + 1) for i in range(300, 340)] * bool(n) + [(1, None)]
        root = {}

        def find(x, root=root):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"))))
        assert got == {x: find(x) for x in list(root)}


def test_thresholds_that_would_lose_links_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="two size bands"):
        ngram_join.near_duplicates(df, num=70, den=100)


def test_packing(spark, docs):
    got = packing.pack(docs, WORD, end_id=0).collect()
    ids = {r.doc_id: library_ids(WORD, r.text, 0) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id for r in got} == set(ids)
    places = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        assert 1 <= r.length <= 2048 and r.start == 2048 * r.piece
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 2


@pytest.mark.parametrize("capacity", [10, 100])
def test_best_fit_is_tight(capacity):
    r = np.random.default_rng(0)
    sizes = r.integers(1, capacity, 3000)
    bins, offsets, fill = packing.best_fit(sizes, capacity)
    assert fill.max() <= capacity and fill.sum() == sizes.sum()
    assert len(fill) <= 1.05 * max(np.ceil(sizes.sum() / capacity), (sizes > capacity / 2).sum())
    assert (offsets + sizes <= fill[bins]).all()


def packed_spans(spark, rows, parts, **more):
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = packing.pack(df, WORD, end_id=0, **more).collect()
    spans = {}
    for x in got:
        spans.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in spans.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(got) == len(rows)
    return got, spans


@pytest.mark.parametrize("more", [{}, {"task": 16, "fan": 2}, {"task": 8, "fan": 16}])
def test_packing_in_rounds(spark, more):
    """Bins that cannot pair stay with the task that made them; the few of at most half find room elsewhere."""
    r = random.Random(7)
    counts = [[r.randint(1100, 1900) for _ in range(12)] + [r.randint(50, 900)] for _ in range(8)]
    rows = [(100 * t + k, "the " * n) for t, part in enumerate(counts) for k, n in enumerate(part)]
    got, spans = packed_spans(spark, rows, 8, **more)
    assert sum(x.length > 1024 for x in got) == 96
    assert not more or len({x.sequence_id >> 32 for x in got if x.length > 1024}) > 4
    assert len(spans) <= len(packing.best_fit(np.asarray([x.length for x in got]), 2048)[2]) + (1 if more else 0)


@pytest.mark.parametrize("order", ["by length", "mixed"])
@pytest.mark.parametrize("more", [{}, {"task": 100}])
def test_packing_of_clustered_tables(spark, order, more):
    """Half of the documents need the other half to fill a sequence, wherever they lie."""
    rows = [(k, "the " * (1100 if k < 300 else 900)) for k in range(600)]
    if order == "mixed":
        random.Random(1).shuffle(rows)
    _, spans = packed_spans(spark, rows, 8, **more)
    # With tasks of a hundred pieces chance leaves some without a partner.
    assert len(spans) <= (303 if not more else 340)


def test_words_give_the_library_ids():
    r = random.Random(4)
    letters = "ab .,\n!'́é1½²Σ\t|$%"
    texts = ["", "  a", "a\n\nb", "don't stop", "x² y½.", "<|endoftext|> hi", "hi <|endoftext|> yo", "a <|startoftext|>", "Σας ΣΑΣ İx ǅ", "a\u2009b c\x1cd", "x" * 9000, "It's. we're!"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for path in (BYTE, WORD):
        library = Tokenizer.from_file(path)
        assert tokens.WordIds(path)(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        library.encode_special_tokens = True
        assert tokens.WordIds(path, special_as_text=True)(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files(docs):
    got = sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_file.read_token_files(token_file.write_token_files(docs, BYTE, 2)).collect())
    data = sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect())
    at, want = 0, []
    for i, t in data:
        ids = library_ids(BYTE, t, 2)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want


@pytest.mark.parametrize("high", [2, 50_000, 2**32 - 1])
def test_blocks_round_trip(high):
    r = np.random.default_rng(1)
    ids = r.integers(0, high, 5 * 1024, dtype=np.uint32)
    ids[::13] = high
    blocks = token_file.encode_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    assert (token_file.decode_blocks(b"".join(blocks), starts) == ids).all()


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html><body><nav>menu</nav><article><h1>A &amp; B</h1><p>One\n two<p>three</article><footer>f</footer></body></html>"
    rows = [
        (1, "http://a.b/x/1", body), (2, "http://a.b/x/2", body), (3, "http://a.b/x/3", None), (4, None, "<p>x"), (5, "//weird", "short"), (5, "//weird", "short"), (None, "http://a.b/y", body),
        (6, "http://c.d/1", "<div>top</div><div>own one</div><div>end</div>"), (7, "http://c.d/2", "<div>top</div><div>own two</div><div>end</div>"),
    ]
    return table(spark, rows, "page_id long, url string, html string")


def test_html(pages):
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(pages).collect()}
    assert got[1, "http://a.b/x/1"] == got[2, "http://a.b/x/2"] == got[None, "http://a.b/y"] == "A & B\nOne two\nthree"
    assert got[3, "http://a.b/x/3"] == ""
    assert got[4, None] == "x"
    assert html_extract.extract(pages).where("page_id = 5").count() == 2
    # Lines that neighbours share are the site's.
    assert (got[6, "http://c.d/1"], got[7, "http://c.d/2"]) == ("own one", "own two")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>a<script>b()</script> c</p><aside>no</aside><form>no</form><section class='comments'>no</section></article>", "a c"),
        ("<div class='cookie-notice'>no</div><main><h2>t</h2><ul><li>1<li>2</ul>x&nbsp;y</main>", "t\n1\n2\nx y"),
        ("<article>cut off <b>here", "cut off here"),
        ("<article><p>&lt;i&gt; &#233;&eacute;</p><!-- no --></article>", "<i> éé"),
        # A named region inside an article is one only as a container, and not where it is most of the article.
        ("<article><p id='share'>stays</p><h2 class='notice'>too</h2></article>", "stays\ntoo"),
        ("<article><div class='related'><p>all of the text stands in here</p></div><p>x</p></article>", "all of the text stands in here\nx"),
        # A teaser is not the article.
        ("<article class='card'>teaser</article><div><p>the real text of the page</p><p>goes on</p></div>", "teaser\nthe real text of the page\ngoes on"),
        ("", ""),
    ],
)
def test_html_cases(html, text):
    assert html_extract.main_text(html_extract.lines_of(html), None) == text


def _alignment(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_many_equal_lines_align_soon():
    r = random.Random(2)
    a, b = ([r.choice("ab") for _ in range(1500)] for _ in range(2))
    found = sorted(html_extract.common_lines(a, b))
    assert len(found) == _alignment(a, b)
    # What is found is a subsequence of the other page, too.
    rest = iter(b)
    assert all(a[i] in rest for i in found)


def test_hostile_pages_end_soon():
    assert html_extract.lines_of("<b>" * 60_000 + "</i>" * 60_000 + "x")
    assert html_extract.lines_of("<div>" + "<b>" * 60_000 + "<div></div>" * 60_000 + "x")


def _brute_pages(rows):
    """Texts by pairing every page with its neighbours in the sorted list of all pages."""
    import re

    def key(row):
        i, url, html = row
        host, path = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url).groups()
        return host.lower(), path, i

    rows = sorted(rows, key=key)
    pages = [html_extract.lines_of(h) for *_, h in rows]
    out = {}
    for at, row in enumerate(rows):
        near = []
        for side in (-1, 1):
            if 0 <= at + side < len(rows) and key(rows[at + side])[0] == key(row)[0]:
                a, b = key(row)[1], key(rows[at + side])[1]
                same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                near.append((same, -side, pages[at + side]))
        other = max(near, key=lambda x: x[:2])[2] if near else []
        lines = pages[at]
        gone = set()
        if other != lines:
            a, b = [t for t, *_ in lines], [t for t, *_ in other]
            gone = {i for i in range(len(a)) if _alignment(a[:i] + a[i + 1 :], b) < _alignment(a, b)}
        out[row[0]] = "\n".join(t for i, (t, _, mark) in enumerate(lines) if not mark and i not in gone)
    return out


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_differencing_is_the_same_on_any_partitions(spark, partitions):
    r = random.Random(9)
    rows = []
    for i in range(60):
        host = r.choice(["a.b", "A.b", "c.d"])
        lines = [f"top of {host.lower()}", f"own {i}", *([f"block {i % 3}"] if i % 2 else []), f"more {i}", "imprint"]
        rows.append((i, f"http://{host}/{r.choice('xyz')}/{r.randint(0, 99)}?q={i}", "".join(f"<div>{t}</div>" for t in lines)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _brute_pages(rows)
    assert not any("top of" in t or "imprint" in t for t in got.values())


def test_common_lines():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_extract.common_lines(a, b)) == best[-1][-1]


def test_warc(pages):
    index = warc.write_archives(pages)
    rows = warc.read_records(index).collect()
    data = {r.page_id: r.html or "" for r in pages.select("page_id", "html").collect()}
    assert len(rows) == 9
    for r in rows:
        text = data[r.page_id]
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == hashlib.sha256(text.encode()).hexdigest()
        assert (r.record_type == "revisit") == (r.refers_to is not None) == (r.page_id in (2, None))
        assert r.payload == (None if r.refers_to else text)
    assert {r.refers_to for r in rows} == {None, 1}
    whole = {(r.page_id, r.url): (r.payload_bytes, r.payload_digest) for r in rows}
    found = warc.resolved(warc.read_records(index, payloads=False).drop("payload")).collect()
    assert len(found) == 9 and all((r.payload_bytes, r.payload_digest) == whole[r.page_id, r.url] for r in found)
    # A revisit whose response isn't there has no payload to tell of.
    alone = warc.resolved(warc.read_records(index.where("page_id = 2"), payloads=False).drop("payload")).first()
    assert (alone.record_type, alone.refers_to, alone.payload_bytes, alone.payload_digest) == ("revisit", 1, None, None)
    # Single records are found by the index.
    assert warc.read_records(index.where("page_id = 3")).first().url == "http://a.b/x/3"


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100_000_000, 7)]) == [(0, 15, [0, 1]), (100_000_000, 100_000_007, [2])]


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi ### </turn> \\"), (1, 1, "assistant", "a#####b</turn>"), (1, 1, "assistant", "a#####b</turn>"), (2, None, None, None), (2, 3, "assistant", ""), (None, 1, "tool: x", "é🙂"),
    ]
    df = table(spark, rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    turns = lambda *pairs: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == turns(("user", "hi ### </turn> \\"), ("assistant", "a#####b</turn>"), ("assistant", "a#####b</turn>"))
    assert got[1].loss_chars == 28 and got[1].loss_sha256 == hashlib.sha256(b"a#####b</turn>a#####b</turn>").hexdigest()
    assert got[2].turns_sha256 == turns(("", ""), ("assistant", "")) and got[2].loss_chars == 0
    assert got[None].turns_sha256 == turns(("tool: x", "é🙂"))


def test_pieces_are_the_library_s():
    import sentencepiece

    model, encode = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.encoder(PIECE)
    r = random.Random(1)
    letters = "abcdeth .,\n!é日本x½  ÜñЖ\t1290"
    texts = ["", " ", "a", "\n", "a b ", "  a", "a\n\n b", "🙂 x", "don't ▁ x"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
    assert got == model.encode(texts)
    assert [encode.vocabulary.decode(np.asarray(x)) for x in got] == model.decode(got)


def test_long_words_and_blank_runs_end_soon():
    import sentencepiece

    model, encode = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.encoder(PIECE)
    r = random.Random(6)
    texts = [" " * 100_000, "word" * 25_000, "é🙂" * 20_000, "".join(r.choice("etaoin srhldcu") for _ in range(100_000)), "".join(r.choice("etaoinsrhldcu") for _ in range(100_000))]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == model.encode(texts)


def test_words_alone_and_together_are_alike():
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca"]
    r = random.Random(4)
    for bpe in (False, True):
        vocabulary = pieces.Vocabulary(names, [-0.3 - 0.7 * k / 2 for k in range(len(names))], [True] * len(names), [], 0, bpe=bpe)
        words = ["".join(r.choice("abcx") for _ in range(12)) for _ in range(300)]
        assert vocabulary.viterbi(words) == [vocabulary.advance_one(w, block=5) for w in words]
        if bpe:
            assert vocabulary.viterbi(words) == [[vocabulary.by_text.get(p, len(names)) for p in vocabulary.merged(w)] for w in words]


def test_unigram_viterbi_matches_all_segmentations():
    r = random.Random(2)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab"]
    vocabulary = pieces.Vocabulary(names, [-r.random() * 3 - len(n) for n in names], [True] * 8, [], 0, bpe=False)

    def best(word):
        if not word:
            return 0.0, []
        return max(((vocabulary.score[i] + best(word[len(n) :])[0], [i] + best(word[len(n) :])[1]) for i, n in enumerate(names) if word.startswith(n)), key=lambda x: x[0])

    for size in range(1, 9):
        words = sorted({"".join(r.choice("abc") for _ in range(size)) for _ in range(20)})
        assert vocabulary.viterbi(words) == [best(w)[1] for w in words]


def test_pieces_frame(docs):
    encoded = pieces.encode_documents(docs, PIECE)
    back = pieces.decode_documents(encoded, PIECE)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert all(r.text == texts[r.doc_id] for r in back.collect())
    assert pieces.digests(docs, PIECE).where("not round_trip").count() == 0


def _brute_vectors(rows, cosine):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0}
    root = {i: i for i in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(good, 0)
    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links.get(i, 0), find(i) if i in good else i) for i, _ in rows if i is not None}


def test_embeddings_of_two_lengths(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = []
    for first, size, n in ((0, 16, 240), (1000, 24, 160), (2000, 5, 3)):
        base = r.normal(size=(30, size))
        rows += [(first + i, (base[i % 30] + r.normal(size=size) * r.choice([0.0, 0.1, 0.3])).tolist()) for i in range(n)]
    rows += [(3000, rows[-1][1]), (3001, [1.0] * 7)]
    order = r.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_join, "LIST_SIZE", 40)
    monkeypatch.setattr(embedding_join, "BLOCK", 2)
    monkeypatch.setattr(embedding_join, "MEMBERS", 16)
    monkeypatch.setattr(embedding_join, "VISITORS", 32)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_join.embedding_groups(df).collect()}
    want = _brute_vectors(rows, 0.9)
    assert all(any(want[i][0] for i, v in rows if len(v) == size) for size in (5, 16, 24))
    assert got == want


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + r.normal(size=16) * r.choice([0.0, 0.1, 0.3])).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [1.0] * 3), (1006, [2 * x for x in rows[0][1]]), (None, rows[0][1])]
    df = table(spark, rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_join, "LIST_SIZE", 40)
    monkeypatch.setattr(embedding_join, "BLOCK", 2)
    monkeypatch.setattr(embedding_join, "MEMBERS", 16)
    monkeypatch.setattr(embedding_join, "VISITORS", 32)
    got = embedding_join.embedding_groups(df).collect()
    want = _brute_vectors(rows, 0.9)
    wrong = [(r.vec_id, r.n_links, r.component_id, want[r.vec_id]) for r in got if r.vec_id is not None and (r.n_links, r.component_id) != want[r.vec_id]]
    found, there = sum(r.n_links for r in got if r.vec_id is not None), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.99 * there, wrong[:5]
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


@pytest.mark.parametrize("rank", [3, 32])
def test_no_link_near_the_threshold_is_lost(rank):
    """Displacements along few directions, too: a pair is seen from one side at least, and the look-up bound lets it through."""
    r = np.random.default_rng(rank)
    n, d = 3000, 32
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=(n, rank)) @ r.normal(size=(rank, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    index, radius = embedding_join.Index(np.concatenate([x, y]), 40), np.sqrt(0.2)
    home = embedding_join._nearest(x, index.centres), embedding_join._nearest(y, index.centres)
    rows = np.arange(n)
    seen = index.visits(x, home[0], radius)[rows, home[1]] | index.visits(y, home[1], radius)[rows, home[0]]
    assert seen.all()
    for at in range(40):
        mine = np.flatnonzero(home[1] == at)
        codes, left = index.encode(y[mine], home[1][mine])
        near = index.distances(x[mine], at, codes)[np.arange(len(mine)), np.arange(len(mine))]
        assert (near <= (radius + left) ** 2 + embedding_join.ROUNDING).all()


def test_quality(spark, docs):
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "bright", "window", "slow"]) + str(r.randint(0, 999)) for _ in range(80))
    bad = lambda: " ".join("buy*** now$$$" for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), f"s{i % 5}", "en") for i in range(400)]
    df = table(spark, rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, 400, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == 400
    assert sum(r.good == bool(r.doc_id % 4) for r in got) >= 396
    # Odd rows are scored, and without labels everything is good.
    assert quality.quality_scores(docs, labels).count() == docs.count()
    assert quality.quality_scores(docs, labels.limit(0)).where("good").count() == docs.count()


def test_quality_sites_match_plain_sums(spark):
    """Host and path posteriors, their shrinking and the decision, from the same evidence by plain loops."""
    r = random.Random(11)
    words = ["river", "stone", "walks", "under", "bright", "window"]
    rows = []
    for i in range(240):
        bad = r.random() < (0.6 if i % 4 == 0 else 0.1)
        text = " ".join("buy*** now$$$" for _ in range(r.randint(3, 30))) if bad else " ".join(r.choice(words) for _ in range(r.randint(5, 60)))
        rows.append((i, text, f"host{i % 4}", r.choice(["en", "de", None]), not bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, is_good boolean")
    marks = [(i, int(g)) for i, _, _, _, g in rows if i % 2]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumns({c: F.lit("clash") for c in ("host", "path", "y", "fold", "salt")})
    got = {x.doc_id: x for x in quality.quality_scores(df, labels).collect()}
    ones = sum(y for _, y in marks)
    prior = np.log((ones + 1) / (len(marks) - ones + 1))
    p = {i: 1 / (1 + np.exp(-(got[i].evidence + prior))) for i in got}
    site = {i: (h, f or "") for i, _, h, f, _ in rows}
    groups = {}
    for i, key in site.items():
        groups.setdefault(key, []).append(p[i])
    hosts = {}
    for (h, _), ps in groups.items():
        hosts.setdefault(h, []).extend(ps)

    def strength(sites):
        """Of (values, parent share) pairs, by moments."""
        n = sum(len(v) for v, _ in sites)
        spread = sum(len(v) * (np.mean(v) - m) ** 2 for v, m in sites)
        between = (spread - sum(m * (1 - m) for _, m in sites)) / n
        within = sum(len(v) * m * (1 - m) for v, m in sites) / n
        return float(np.clip(within / between - 1 if between > 0 else quality.MOST_STRENGTH, quality.LEAST_STRENGTH, quality.MOST_STRENGTH))

    whole = np.mean(list(p.values()))
    k = strength([(v, whole) for v in hosts.values()])
    host_share = {h: (sum(v) + k * whole) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(v, host_share[h]) for (h, _), v in groups.items()])
    for i, (h, f) in site.items():
        v = groups[h, f]
        share = (sum(v) - p[i] + k * host_share[h]) / (len(v) - 1 + k)
        odds = got[i].evidence + np.log(share / (1 - share))
        assert got[i].path_share == pytest.approx(share, abs=1e-9) and got[i].score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
        assert got[i].good == (odds >= 0)


def test_grams_are_those_of_each_text():
    r = random.Random(5)
    texts = ["", "a", "abc", "abcd", "é日本 x", " \n", "one two  three", "".join(r.choice("ab é\n") for _ in range(500))]
    together = quality.grams(texts)
    for kind in (0, 1):
        buckets, counts = together[kind]
        parts = np.split(buckets, np.cumsum(counts)[:-1])
        for t, part in zip(texts, parts, strict=True):
            alone = quality.grams([t])[kind]
            assert part.tolist() == alone[0].tolist() and alone[1].tolist() == [len(part)]
        assert counts.tolist() == ([len(t.split()) for t in texts] if kind == 0 else [len(t.encode()) for t in texts])


def test_sparse_sites_shrink_to_the_global_share(spark):
    rows = [(i, "some plain words here", "big", "en") for i in range(50)] + [(100, "some plain words here", "tiny", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    assert got[100].path_share == pytest.approx(got[0].path_share, abs=1e-6)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert ngram_join.near_duplicates(docs).count() == 0
    assert packing.pack(docs, WORD, 0).count() == 0
    assert token_file.read_token_files(token_file.write_token_files(docs, BYTE, 2)).count() == 0
    assert pieces.digests(docs, PIECE).count() == 0
    assert quality.quality_scores(docs, labels).count() == 0
    assert html_extract.extract(pages).count() == 0
    assert warc.read_records(warc.write_archives(pages)).count() == 0
    assert chat.conversation_digests(chat.format_conversations(turns)).count() == 0
    assert embedding_join.embedding_groups(vectors).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 3:
            assert out.columns == now.columns
            out.write.parquet(f"{tmp_path}/{k}.parquet")
            now = spark.read.parquet(f"{tmp_path}/{k}.parquet")
            sizes.append(sorted(r.doc_id for r in now.select("doc_id").where("doc_id is not null").collect()))
    assert sizes[0] == sorted([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, -5, 15])
    # Copies: of 1, 2, 2, 3 the first; of 4, null, -5 the longest; of the empty ones the one with most characters.
    assert sizes[1] == [-5, 1, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    # Near copies: 12 of 11; 9, 10 and 15 differ in case alone.
    assert sizes[2] == [-5, 1, 7, 8, 9, 11, 13, 14]
    assert {r.doc_id for r in out.collect()} - {None} == set(sizes[2])


def _run_pipeline(spark, folder, rows, labels=((10**6, 1, 0),)):
    import corpus_pipeline

    extra = {c: F.lit("clash") for c in ("id", "_id", "_check", "check", "hash", "row_id", "n", "dropped")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(extra)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(folder))
        out.write.parquet(f"{folder}/out{k}")
        now = spark.read.parquet(f"{folder}/out{k}")
        kept.append(now)
    return kept


def test_pipeline_tells_rows_apart_by_id_and_text(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w5 ", "v5 ")
    rows = [
        (1, "same text"), (2, "same text"), (2, "another text altogether"), (None, "same text"), (None, "a text of no id"), (None, None), (7, ""),
        (3, long), (4, near), (4, "a third text that stands alone"), (None, near + " x"),
    ]
    kept = _run_pipeline(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])
    by_stage = [sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()) for df in kept[:3]]
    stays = lambda *pairs: sorted((i is None, i or 0, t or "") for i, t in pairs)
    assert by_stage[0] == stays(*rows)
    unique = [(1, "same text"), (2, "another text altogether"), (None, "a text of no id"), (7, ""), (3, long), (4, near), (4, "a third text that stands alone"), (None, near + " x")]
    assert by_stage[1] == stays(*unique)
    assert by_stage[2] == stays((1, "same text"), (2, "another text altogether"), (None, "a text of no id"), (7, ""), (3, long), (4, "a third text that stands alone"))
    assert kept[3].count() == 6


def test_pipeline_of_nothing(spark, tmp_path):
    kept = _run_pipeline(spark, tmp_path, [])
    assert [df.count() for df in kept] == [0, 0, 0, 0]


def test_pipeline_leaves_one_of_alike_rows(spark, tmp_path):
    """Rows alike in id and text, copies without ids, forms of one text under one id, and the largest id that there is."""
    top = (1 << 63) - 1
    long = " ".join(f"w{k}" for k in range(60)) + "."
    other = " ".join(f"v{k}" for k in range(60)) + "."
    rows = [(7, long), (7, long), (7, long), (top, long), (top, other), (top, other), (None, "n n n"), (None, "n n n"), (None, "n  n n"), (None, None), (3, "a b"), (3, "a  b"), (3, "a  b"), (3, "c")]
    kept = _run_pipeline(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])
    want = [(7, long), (top, other), (None, "n  n n"), (None, ""), (3, "a  b"), (3, "c")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for k in (1, 2):
        assert sorted(((r.doc_id, r.text or "") for r in kept[k].collect()), key=key) == sorted(want, key=key)
    import corpus_pipeline

    alone = spark.createDataFrame([(i, t, "en", "s") for i, t in rows if t != "a b"], "doc_id long, text string, lang string, source string")
    near = corpus_pipeline.keep_one_near_copy(spark, alone, str(tmp_path)).collect()
    assert sum(r.text == long for r in near) == 1 and sum(r.text == other for r in near) == 1 and sum(r.doc_id is None and r.text in ("n n n", "n  n n") for r in near) == 1


def test_pages_without_an_id_revisit(spark):
    """The query and its SQL agree on pages without an id, whichever payload they have."""
    import duckdb

    big, own = "x" * 200, "y" * 300
    rows = [(1, "u", big), (None, "u", big), (3, "u", big), (1, "v", big), (None, None, own), (None, "w", own), (5, "u", "small"), (None, "u", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(df)
    got = warc.resolved(warc.read_records(index, payloads=False).drop("payload")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = df.toArrow()  # noqa: F841
    want = duckdb.sql(warc.ORACLE).fetchall()
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert ("revisit", 1) in {(r[3], r[4]) for r in want if r[0] is None}


def test_vectors_of_extreme_sizes(spark):
    rows = [(1, [1e-200, 0.0, 1e-200]), (2, [1e200, 0.0, 1.1e200]), (3, [1.0, 0.0, 1.0]), (4, [0.0, 5e-324, 0.0]), (5, [0.0, 1.7e308, 1e300]), (6, [-1e-300, 0.0, -1e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_vectors_without_structure_visit_few_lists():
    """The work of a vector is what it visits: a fifth of the lists here, about half with lists of 256; and tables between lists are not broadcast."""
    x = np.random.default_rng(3).normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_join.Index(x, len(x) // embedding_join.LIST_SIZE)
    assert len(pickle.dumps(index)) < 1.5 * (index.centres.nbytes + sum(c.nbytes for c in index.codes))
    home, lists = embedding_join._nearest(x, index.centres), np.arange(len(index.centres))
    sizes = np.bincount(home, minlength=len(lists))
    visits = index.visits(x[:500], home[:500], np.sqrt(0.2), lists)
    assert (visits @ sizes).mean() < 0.3 * len(x)
    # Of two vectors in two lists the one nearer to the border visits, whatever the other does, if they are linked.
    y = x[:500] + np.random.default_rng(4).normal(size=(500, 64)) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    there = embedding_join._nearest(y, index.centres)
    linked = ((x[:500] * y).sum(axis=1) >= 0.9) & (home[:500] != there)
    out, back = index.to_border(x[:500], home[:500], there), index.to_border(y, there, home[:500])
    rows = np.arange(500)
    assert linked.sum() > 20
    assert np.where(out <= back, visits[rows, there], index.visits(y, there, np.sqrt(0.2), lists)[rows, home[:500]])[linked].all()
