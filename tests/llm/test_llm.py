"""The operators of siftstone.llm against plain versions, and rows that are out of the ordinary."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from siftstone.llm import byte_bpe, common, factorisation, fingerprints, html_text, language, native, ngram_join, packing, quality_rules, registry, suffix_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n", " \n a", "a  b\n\n c\t\td e \n", "日本語 テキスト、です 123", "emoji 😀👍 x", "a   b", "I'm you're 's 't", "ÉCOLE İstanbul ŒUVRE ΣΑΣ", "<|endoftext|> a", "x" * 3000, "\x1c\x1f a\x85b", "12345 6.7 a1b2c3", "ñ̃ é"]


def thue_morse(bits: int) -> tuple[str, str]:
    """A word and its complement, which every polynomial hash modulo 2**64 confuses."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1 << bits))
    return one, one.translate({97: "b", 98: "a"})


ODD += [*thue_morse(11), " ".join(thue_morse(10)), " ".join(thue_morse(10)[::-1]), " ".join(thue_morse(6)[::-1])]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(k, x, "en", "s", len(x or "")) for k, x in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and an extra column whose name clashes."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (4, "one two three four five six", "en", "s", 1), (4, "one two three four five six", "en", "s", 1), (5, "one two three four five six", None, "s", 1), (None, "one two three four five six", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def query(spark, name):
    return [f for k, f in registry.queries().items() if k.startswith(name)][0](spark, FOLDER)


def test_fingerprints(spark, texts):
    found = {r.doc_id: r for r in query(spark, "op1_").collect()}
    ids = sorted(texts)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        q = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - q] + texts[b][:q]
        assert found[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[a].n_chars == len(texts[a])
        assert 0 <= found[a].near_edited <= 1 and 0 <= found[a].near_next <= 1
    by_text = collections.defaultdict(set)
    for k, x in texts.items():
        by_text[x].add(found[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.median([r.near_edited for r in found.values()]) > 0.4 > 0.1 > np.median([r.near_next for r in found.values()])


def test_short_texts_have_fingerprints(spark):
    texts = [" ".join(f"{a}{n}{k}" for k in range(n)) for n in (1, 4, 5, 6, 7) for a in "abcdefghijklmnop"]
    found = fingerprints.fingerprint_edits(documents(spark, [*texts, " "])).collect()
    by = {r.doc_id: r for r in found}
    assert all(by[k].fingerprint and by[k].edited_fingerprint for k in range(len(texts))) and by[len(texts)].fingerprint == ""
    assert len({r.fingerprint for r in found}) == len(found)
    assert all(r.near_next < 1 for r in found) and by[len(texts) - 1].near_next == 0


def test_anchors_do_not_depend_on_their_surroundings(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    df = documents(spark, [f"a b c {passage}", f"{passage} x y z"])
    found = collections.defaultdict(dict)
    for r in fingerprints.anchors(df).collect():
        found[r.doc_id][r.anchor] = r.word_place
    inside = [a for a, at in found[1].items() if at <= 35]
    assert inside and all(found[0][a] == found[1][a] + 3 for a in inside)


def test_language(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = query(spark, "op2_").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_profile_ranks_by_hand():
    known = {"x": language._ranked(*language._count("aa ab aa"), 3).tolist(), "y": language._ranked(*language._count("zz zy"), 3).tolist()}
    ranks = language.Ranks(known, 3)
    assert ranks.nearest("aa ab aa") == ("x", 1.0)
    assert ranks.nearest("12 !") == ("und", 0.0)
    codes, counts = language._count("ab")
    assert sorted(counts.tolist()) == [1] * len(codes) and len(codes) == 2 + 3 + 2  # a b, _a ab b_, _ab ab_
    whole = language._count("the cat and the hat " * 9)
    size, language.PIECE = language.PIECE, 40
    try:
        parts = language._count("the cat and the hat " * 9)
    finally:
        language.PIECE = size
    assert whole[0].tolist() == parts[0].tolist()


def test_byte_bpe_is_tiktoken(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    all_texts = [*ODD, *texts.values()]
    df = documents(spark, all_texts)
    for r in byte_bpe.round_trip(df, path, P.PATTERN).collect():
        ids = own.encode_ordinary(all_texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(all_texts[r.doc_id].encode()).hexdigest()
    encoded = byte_bpe.encode(documents(spark, ODD), path, P.PATTERN)
    for r in encoded.collect():
        text, at = ODD[r.doc_id], 0
        for k, end in zip(r.ids, r.char_ends, strict=True):
            at += len(own.decode_single_token_bytes(k))
            assert end == len(text.encode()[:at].decode("utf-8", "ignore"))
    for r in byte_bpe.decode(encoded, path, P.PATTERN).collect():
        assert r.text == ODD[r.doc_id] and r.bytes == ODD[r.doc_id].encode()
    split = spark.createDataFrame([(1, own.encode_ordinary("😀")[:1])], "doc_id int, ids array<int>")
    assert byte_bpe.decode(split, path, P.PATTERN).first().text == "�"


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    bins, codes = rng.integers(0, 64, (20, 1 + len(toxicity.PARTS))), rng.integers(0, 20, 100)
    first, size, target = np.array([0, 40, 90]), np.array([32, 32, 7]), np.array([1.0, 0, 1])

    def run(keep):
        at = codes[np.minimum(first + np.arange(toxicity.WINDOW)[:, None], 99)]
        table = net.projected(bins)
        return net.forward(np.stack([table[0][at], table[1][at[::-1]]]), size, keep)

    def loss():
        s = 1 / (1 + np.exp(-run(False).astype(np.float64)))
        return -(target * np.log(s) + (1 - target) * np.log(1 - s)).mean()

    y, kept = run(True)
    g, _ = net.backward(((1 / (1 + np.exp(-y)) - target) / 3).astype(np.float32), kept)
    for name in ("u", "b", "wa", "va", "wo", "bo"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        high = loss()
        net.p[name][at] = old - step
        low = loss()
        net.p[name][at] = old
        assert (high - low) / 2 / step == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def made_up(rng, bad):
    words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
    if bad:
        words[rng.randrange(len(words))] = rng.choice(["vilexa", "vilexor", "grubble"])
    return " ".join(words)


def test_toxicity_finds_rare_words_anywhere(spark):
    rng = random.Random(5)
    labels = [(k, int(k % 4 == 0)) for k in range(600)]
    df = documents(spark, [made_up(rng, y) for _, y in labels])
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(df, lab, "toxic", F.col("doc_id") < 400)
    found = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert np.mean([(found[k] >= 0.3) == (y == 1) for k, y in labels[400:]]) > 0.97
    assert toxicity.fit(df, lab.where("toxic = 0"), "toxic", F.lit(True)) is None


def test_quality_held_out(spark):
    rng = random.Random(6)
    labels = [(k, int(k % 3 > 0)) for k in range(600)]
    df = documents(spark, [made_up(rng, False) if y else "!! ".join(made_up(rng, False).upper().split()) for _, y in labels])
    machine = factorisation.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", F.col("doc_id") < 400)
    found = {r.doc_id: r.score for r in factorisation.score(df, machine).collect()}
    assert np.mean([(found[k] >= 0.5) == (y == 1) for k, y in labels[400:]]) > 0.97


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = factorisation.Machine()
    m.w = rng.normal(size=m.w.shape).astype(np.float32)
    f, x = rng.choice(factorisation.SIZE, 7, replace=False), rng.normal(size=7).astype(np.float32)
    want = float(m.w[f] @ x) + sum(float(m.v[f[i]] @ m.v[f[k]]) * x[i] * x[k] for i in range(7) for k in range(i))
    assert m.parts(f, x, np.array([0, 7]))[0][0] == pytest.approx(want, rel=1e-4)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tk.encode_special_tokens = True
    all_texts = [*ODD, *texts.values(), " ".join(f"w{k}" for k in range(4000))]
    pieces = collections.defaultdict(list)
    seen = set()
    for r in packing.pack(documents(spark, all_texts), P.path("word_bpe_49k.json")).collect():
        assert r.sequence_id not in seen and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096
        seen.add(r.sequence_id)
        pieces[r.doc_id].append(r)
    for k, text in enumerate(all_texts):
        ids = [*tk.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[k], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)


def test_quality_rules(spark, texts):
    found = {r.doc_id: r for r in query(spark, "op7_").collect()}
    for k, x in texts.items():
        w = WORD.findall(x)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times, cover = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                cover.update(range(i, i + 5))
        full = [x for x in x.split("\n") if WORD.search(x)]
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x.count(s) for s in "#*$%&|<>"), len(full) - len(set(full)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def shingle_sets(texts):
    low = {ord("A") + k: ord("a") + k for k in range(26)}
    out = {}
    for k, x in texts.items():
        w = WORD.findall(x.translate(low))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("heavy", [3, 16])
def test_ngram_join(spark, heavy, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_ROWS", heavy)
    if heavy == 3:
        monkeypatch.setattr(ngram_join, "FLUSH", 300)
        monkeypatch.setattr(ngram_join, "BLOCK", 500)
        monkeypatch.setattr(ngram_join, "GRID_ROWS", 2)
    rng = random.Random(heavy)
    base = [[f"t{rng.randrange(50)}" for _ in range(60)] for _ in range(8)]
    texts = {}
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts[k] = " ".join(words[: rng.choice([2, 4, 5, 55, 60])]).upper() if k % 3 else " ".join(words)
    texts |= {200: "", 201: " ", 202: "a b", 203: "A  b"}
    sets, root = shingle_sets(texts), {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            common_size = len(sets[a] & sets[b])
            if a < b and common_size and 100 * common_size >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(documents(spark, list(texts.values()), list(texts))).collect()}
    assert found == {k: (len(sets[k]), find(k)) for k in texts}


def brute_cut(texts, length=50):
    first, out = {}, {}
    for k in sorted(texts):
        b = texts[k].encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], k)
    for k, x in texts.items():
        b = x.encode()
        keep = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                keep[i : i + length] = False
        runs = int((~keep & np.append(True, keep[:-1])).sum()) if len(b) else 0
        out[k] = (len(b), int((~keep).sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[keep])).hexdigest())
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcdé ", k=rng.randrange(40, 400))) for _ in range(12)]
    texts = {k: "".join(rng.choice(passage)[rng.randrange(30) :] + "".join(rng.choices("xyz ", k=rng.randrange(30))) for _ in range(rng.randrange(4))) for k in range(80)}
    texts |= {90: "a" * 500, 91: "b" + "a" * 300, 92: "ab" * 200, 93: "", 94: "é" * 49, 95: "é" * 30}
    for limit in (1 << 20, 400):
        monkeypatch.setattr(common, "BLOCK_BYTES", limit)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 4000)
        df = documents(spark, list(texts.values()), list(texts))
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, form="sha256").collect()}
        assert found == brute_cut(texts)


def test_suffix_dedup_splits_heavy_triggers(spark, monkeypatch):
    rng = random.Random(4)
    letters = [chr(97 + k) for k in range(26)]
    made = lambda n: "".join(rng.choices(letters, k=n))
    # the string of eight letters that is the trigger wherever it stands
    word = min((made(8) for _ in range(3000)), key=lambda x: suffix_dedup.phrases(np.frombuffer((x * 7).encode(), np.uint8)[:8], np.array([0, 8]), 8)[0][0])
    passage = made(30) + word + made(90)
    texts = {k: "".join(made(40) + word for _ in range(12)) + (passage[rng.randrange(40) :] if k % 3 == 0 else "") for k in range(60)}
    around = word + made(24)
    texts |= {100 + k: made(30) + around + made(30) for k in range(80)} | {70: word * 40, 71: word * 30, 72: "x", 73: passage}
    total = sum(len(x) for x in texts.values())
    df = documents(spark, list(texts.values()), list(texts))
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 1000)
    heavy = suffix_dedup.heavy_keys(df.select(F.col("text").cast("binary")), total)

    def windows(heavy):
        size, keys = collections.Counter(), collections.defaultdict(set)
        for x in texts.values():
            data = np.frombuffer(x.encode(), np.uint8)
            for key, first, run, *_ in zip(*suffix_dedup.phrases(data, np.array([0, len(data)]), 50, heavy), strict=True):
                size[int(key)] += int(run)
                for at in range(first, first + run):
                    keys[x[at : at + 50]].add(int(key))
        assert all(len(x) == 1 for x in keys.values()) and sum(size.values()) == sum(max(0, len(x) - 49) for x in texts.values())
        return size

    whole, once = windows(None), windows((heavy[0], heavy[1][:0]))
    assert {k for k, n in whole.items() if n >= 1000} <= set(heavy[0].tolist()) and whole.most_common(1)[0][1] > 10_000
    assert {k for k, n in once.items() if n >= 1000} <= set(heavy[1].tolist()) and once.most_common(1)[0][1] >= 1000
    assert windows(heavy).most_common(1)[0][1] < 1000
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, form="sha256").collect()}
    assert found == brute_cut(texts)


@pytest.mark.parametrize("length", [3, 8, 13, 50])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_suffix_array_is_lexicographic(length, seed):
    rng = np.random.default_rng(length)
    data = np.concatenate([rng.integers(97, 99, 700), np.tile(rng.integers(0, 256, 90), 6), np.full(120, 255)]).astype(np.uint8)
    window = rng.permutation(len(data) - length + 1)
    value = {0: None, 1: np.array([hash(data[w : w + length].tobytes()) & 0xFFFFFFFF for w in window]), 2: np.zeros(len(window))}[seed]
    order, fresh = suffix_dedup.suffix_array(data, window, length, value)
    found = [data[window[k] : window[k] + length].tobytes() for k in order]
    assert sorted(order.tolist()) == list(range(len(window))) and found == sorted(found)
    assert fresh.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


def test_suffix_dedup_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 300)
    import pyarrow as pa

    text = "".join(random.Random(1).choices("ab ", k=2000)).encode()
    starts = set()
    for _, data, offsets, base in suffix_dedup._segments(pa.array([text], pa.binary()), 50):
        _, first, run, _, _ = suffix_dedup.phrases(data, offsets)
        for a, n in zip(first, run, strict=True):
            assert not starts & set(range(base + a, base + a + n))
            starts |= set(range(base + a, base + a + n))
    assert starts == set(range(len(text) - 49))


def test_html(spark):
    def page(a, b):
        return f"<html><head><title>T</title></head><body><div>Menu one</div><div>Site line</div><div><p>{a}</p><p>{b}</p></div><p>Bottom line</p><ul class='comments'><li>hi</li></ul></body></html>"

    article = "<nav><a href='/x'>Menu</a></nav><article><h1>Ti&amp;tle</h1><p>One<br>two<p>Three <b>bold <div class='ad box'>Buy</div></b></p><aside>side</aside><script>var a='</p>'</script></article><footer>f</footer>"
    rows = [(1, "http://a.com/x/1", page("First story", "text &lt;more")), (2, "http://a.com/x/2.html", page("Second", "story")), (2, "http://a.com/x/2.html", page("Second", "story")), (3, "http://b.com/x/2", page("Alone", "here")), (4, None, None), (5, "::", article), (6, "http://a.com/x/1", "")]
    found = collections.defaultdict(list)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect():
        assert r.n_chars == len(r.text)
        found[r.page_id].append(r.text)
    assert found == {1: ["First story\n\ntext <more"], 2: ["Second\n\nstory"] * 2, 3: ["Menu one\n\nSite line\n\nAlone\n\nhere\n\nBottom line"], 4: [""], 5: ["Ti&tle\n\nOne two\n\nThree bold"], 6: [""]}


@pytest.mark.parametrize("raw", ["<script>for(var i=0;i<n;i++){f(i)}</script>", '<script>var s="<!--";</script>', "<style>a:after{content:'<![CDATA['}</STYLE >", "<script>var a='</scripts>', b=\"<x '\"</script\n>", "<svg/>"])
def test_html_raw_elements_end_at_their_end_tag(raw):
    found = html_text.lines(f"<body>{raw}<article><h1>Title</h1>{raw}<p>One {raw}two</p></article></body>")
    assert found == [("Title", html_text.MAIN), ("One two", html_text.MAIN)]
    assert html_text.lines(f"<p>One</p><script>{'x<y;' * 3}") == [("One", html_text.OPEN)]


@pytest.mark.parametrize("kept", ['<h2 id="related-work">X</h2>', '<h2 id="comments">X</h2>', '<section id="social-impact"><p>X</p></section>', '<p class="share-price">X</p>', '<h2 id="notice-period">X</h2>', '<div id="menu-of-the-day">X</div>'])
def test_html_slugs_inside_an_article_stay(kept):
    for name in ("article", "main"):
        found = html_text.lines(f"<{name}>{kept}<div class='box ad'>Buy</div><div id='comments'>Hi</div></{name}><div class='share-buttons'>Share</div>")
        assert found == [("X", html_text.MAIN), ("Buy", html_text.GONE), ("Hi", html_text.GONE), ("Share", html_text.GONE)]


def test_html_elements_that_nothing_closes():
    for name in ("select", "object", "svg", "video"):
        assert html_text.lines(f"<p>One <{name}> two</p><p>Three</p>") == [("One two", html_text.OPEN), ("Three", html_text.OPEN)]
        nested = f"<p>One</p><{name}>a<{name}>b</{name}>c<p>d</p></{name}><p>Three</p>"
        assert [x for x, kind in html_text.lines(nested) if kind == html_text.OPEN] == ["One", "Three"]


def test_html_lines_of_one_article_repeat_on_its_neighbour(spark):
    rows = [(k, f"http://a.com/x/{k}", f"<p>Menu {k % 2}</p><article><p>Always</p><p>Only {k}</p></article>") for k in range(4)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), counts=True).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Always\n\nOnly {k}" for k in range(4)}
    assert all(r.n_lines == 3 and r.n_shared == 1 and r.n_overruled == 2 for r in found)  # Always is shared and stays, the menu differs and goes


def test_html_neighbours_that_are_equally_near(spark):
    rows = [(k, f"http://a.com/{x}", f"<p>{x}</p><p>{'Before' if k < 2 else 'After'}</p><p>{'After' if k > 0 else 'Before'}</p>") for k, x in enumerate("abc")]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == "b\n\nAfter"


def test_longest_common_lines_of_many_repeated_lines():
    assert len(html_text.common_lines(["x"] * 100_000, ["x"] * 100_000)) == 100_000
    rng = random.Random(8)
    a, b = (rng.choices("ab", k=6000) for _ in range(2))
    found = sorted(html_text.common_lines(a, b))
    it = iter(b)
    assert all(a[k] in it for k in found) and len(found) == html_text._lengths(a, b)[-1] > 4500


@pytest.mark.parametrize("most", [9, 300])
def test_longest_common_lines(most):
    rng = random.Random(most)
    for _ in range(100 if most == 9 else 5):
        a, b = (rng.choices("abcd", k=rng.randrange(most)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
        found = sorted(html_text.common_lines(a, b))
        it = iter(b)
        assert len(found) == t[-1][-1] and all(a[k] in it for k in found)


def _all_operators(spark, df):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    known = language.profiles(df, F.lit(True))
    trusted = spark.createDataFrame([], "id long")
    return {
        "fingerprints": fingerprints.fingerprint_edits(df),
        "language": language.identify(df, known),
        "byte_bpe": byte_bpe.round_trip(df, path, P.PATTERN),
        "toxicity": toxicity.score(df, toxicity.fit(df, labels, "toxic", F.lit(True))),
        "quality": factorisation.score(df, factorisation.fit(df, labels, "quality", F.lit(True))),
        "rules": quality_rules.judge(df, trusted),
        "join": ngram_join.link(df),
        "dedup": suffix_dedup.remove_repeats(df, keep=("kept",)),
    }


def test_odd_rows(spark):
    df = odd_rows(spark)
    found = {k: x.collect() for k, x in _all_operators(spark, df).items()}
    assert all(len(x) == 7 for x in found.values())
    by = lambda name, k: [r for r in found[name] if r.doc_id == k]
    assert by("fingerprints", 1)[0].fingerprint == "" and by("fingerprints", None)[0].near_next is None
    assert by("language", 1)[0].lang_pred == "und" and by("language", 2)[0].score == 0
    assert by("byte_bpe", 1)[0].n_tokens == 0
    assert all(r.score == 0 for r in found["toxicity"]) and all(r.score == 0.5 for r in found["quality"])
    assert by("rules", 2)[0].base_failed and by("rules", 2)[0].score is None
    assert [r.component_id for r in by("join", 5)] == [4] and [r.component_id for r in by("join", 4)] == [4, 4]
    assert by("join", None)[0].component_id is None and by("join", 1)[0].component_id == 1
    pieces = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces) and sum(r.doc_id == 1 for r in pieces) == 1


def test_repeated_ids_with_other_texts(spark):
    same = " ".join(f"q{k}" for k in range(30))
    df = documents(spark, [same, "other words here " + same, same, "nothing of it"], [1, 2, 2, 3])
    rows = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert rows == [(1, 0), (2, len(same)), (2, len(same)), (3, 0)]
    assert {r.component_id for r in ngram_join.link(df).collect() if r.doc_id < 3} == {1}


def test_ids_with_several_texts_reach_through_all_of_them(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    df = documents(spark, [a, a, b, b + " more", "nothing of it"], [1, 2, 2, 3, 4])
    assert {(r.doc_id, r.component_id) for r in ngram_join.link(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_words_that_sums_confuse_do_not_link(spark):
    one, two = thue_morse(11)
    found = {r.doc_id: r.component_id for r in ngram_join.link(documents(spark, [one, two, f"a {one} b c d e", f"a {two} b c d e"])).collect()}
    assert found == {k: k for k in range(4)}


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    first = np.sort(rng.integers(0, 2**63, 500, np.uint64) * np.uint64(2))
    rest = rng.integers(-5, 2**40, 500), np.zeros(500, np.int64)
    found = common.unpack(common.pack(first, *rest))
    assert (found[0] == first).all() and all((x.view(np.int64) == y).all() for x, y in zip(found[1:], rest, strict=True))


def test_empty_tables(spark):
    df = odd_rows(spark).limit(0)
    for name, x in _all_operators(spark, df).items():
        assert x.count() == 0, name
    assert packing.pack(df, P.path("word_bpe_49k.json")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_against_plain_steps(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "suffix_dedup", "packing"]
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs, FOLDER))
        assert out.columns == docs.columns
        now = {r.doc_id: r.text for r in out.collect()}
        assert set(now) <= set(held)
        if name == "near_duplicates":
            sets = shingle_sets(now)
            ids = sorted(now)
            assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
        elif name == "suffix_dedup":
            assert {k: len(x.encode()) for k, x in now.items()} == {k: n - cut for k, (n, cut, _, _) in brute_cut(held).items()}
        else:
            assert all(now[k] == held[k] for k in now)
        docs, held = out, now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == set(held)


def test_native_constants(spark):
    assert spark.range(1).select(native.constants([0.5, -1.25]).alias("x")).first().x == [0.5, -1.25]


def spark_hash(*values):
    """Spark's xxhash64 of texts and longs."""
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        seed = seed - 2**64 if seed >= 2**63 else seed
        last, seed = seed, seed % 2**64
    return last


def plain_sketch(text):
    words = WORD.findall(text)
    if any(len(w) > fingerprints.LONG for w in words):
        words = [x for w in words for x in (w if len(w) > fingerprints.LONG else [w])]
    h = [spark_hash(w) for w in words]
    g = [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]
    found = {spark_hash(g[i], g[i + 2], g[i + 3]) for i in range(len(g) - 3) if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2])}
    if not found and h:
        return None  # one anchor for the whole text
    return sorted(found)[: fingerprints.SIZE]


def test_fingerprints_against_a_plain_version(spark, texts):
    found = {r.doc_id: r for r in query(spark, "op1_").collect()}
    sketches = {k: plain_sketch(x) for k, x in texts.items()}
    ids = sorted(texts)
    for k, sketch in sketches.items():
        if sketch is not None:
            assert found[k].fingerprint == "".join(f"{x % 2**64:016x}" for x in sketch)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        if sketches[a] and sketches[b]:
            least = sorted({*sketches[a], *sketches[b]})[: fingerprints.SIZE]
            assert found[a].near_next == pytest.approx(len({*sketches[a]} & {*sketches[b]} & {*least}) / len(least))


def test_text_without_blanks_loses_only_some_anchors(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900))
    found = fingerprints.fingerprint_edits(documents(spark, [text, "other text that comes next here"])).where("doc_id = 0").first()
    assert 0.3 < found.near_edited < 1


def test_quality_verdicts_against_a_plain_version(spark, texts):
    import math

    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    grams = {}
    for k, x in texts.items():
        h = [spark_hash(w) for w in WORD.findall(x)]
        grams[k] = [v % quality_rules.WORD_BINS for v in h] + [quality_rules.WORD_BINS + spark_hash(a, b) % quality_rules.PAIR_BINS for a, b in zip(h, h[1:], strict=False)]
    ratio = {}
    for low, high in ((0, quality_rules.WORD_BINS), (quality_rules.WORD_BINS, quality_rules.WORD_BINS + quality_rules.PAIR_BINS)):
        raw, trusted = collections.Counter(range(low, high)), collections.Counter(range(low, high))
        for k, g in grams.items():
            own = [b for b in g if low <= b < high]
            raw.update(own)
            trusted.update(own if k in good else [])
        ratio |= {b: math.log(trusted[b] / trusted.total()) - math.log(raw[b] / raw.total()) for b in range(low, high)}
    for r in query(spark, "op7_").collect():
        g = grams[r.doc_id]
        if not g:
            assert r.score is None and not r.kept
            continue
        score = sum(ratio[b] for b in g) / len(g)
        assert r.score == pytest.approx(score, abs=3e-6)
        if abs(score - quality_rules.THRESHOLD) > 1e-5:
            assert r.kept == (not r.base_failed and score >= quality_rules.THRESHOLD)


def test_language_ties_go_to_the_smaller_name():
    known = language._ranked(*language._count("aa ab"), 5).tolist()
    assert language.Ranks({"y": known, "x": known}, 5).nearest("ab ab")[0] == "x"


def test_long_runs_without_blanks_are_counted_whole(monkeypatch):
    text = "abcdefgh" * 40 + " end"
    whole = language._count(text)
    monkeypatch.setattr(language, "PIECE", 50)
    parts = language._count(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_toxicity_network_beats_its_first_inputs_and_reads_both_ways(spark):
    """A word is toxic only right before another one, which single words cannot tell."""
    rng = random.Random(21)

    def text(bad):
        words = [f"w{rng.randrange(60)}" for _ in range(24)]
        at = rng.randrange(20)
        words[at : at + 2] = ["vex", "lum"] if bad else ["lum", "vex"]
        return " ".join(words)

    labels = [(k, k % 2) for k in range(800)]
    df = documents(spark, [text(y) for _, y in labels])
    net = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", F.col("doc_id") < 600)
    scores = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    truth = np.array([y for k, y in labels if k >= 600])
    found = np.array([scores[k] for k, _ in labels if k >= 600])
    ranks = lambda x: (x[truth == 1][:, None] > x[truth == 0][None, :]).mean()
    whole = ranks(found)
    assert whole > 0.6  # order cannot be told from the words' log-odds, which give 0.5
    net.p["u"][1] = 0
    net.p["wx"][1] = 0
    assert abs(ranks(np.array([r.score for r in toxicity.score(df.where("doc_id >= 600"), net).orderBy("doc_id").collect()])) - whole) > 0.01


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline

    odd = odd_rows(spark)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, FOLDER)
            rows = out.collect()
            if name != "packing":
                assert out.columns == df.columns, name
            if df is odd and name in ("suffix_dedup", "packing"):
                assert len(rows) >= 7, name
            elif df is not odd:
                assert not rows, name
            elif name == "near_duplicates":
                assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 4, 4]
