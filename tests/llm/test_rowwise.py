"""Operators that take rows one by one, against the libraries or a round trip."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from granary.llm import webp
from granary.llm.queries import tokenizer_file

TEXTS = [
    None, "", " ", "  ", "a b", "  a\n\tb ▁x\x00y ", "<s>x</s>", "é ﬁ 日本語テキスト😀", "a" * 3000, "▁", "\n\n  x", "<0x0A>",
    "aaaa" * 100 + " " * 77, " x", "x ", "it's  x's I'll\t y\n z", " a  b  c", "Hello, world! Hello, world!", "x" * 64, "ß" * 32,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, None, "again", 2), (5, TEXTS[5], None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts(docs, empty):
    import sentencepiece

    from granary.llm.token_counts import token_counts

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts(docs, path).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    assert token_counts(empty, path).collect() == []


def test_whole_tokens_are_proved():
    import sentencepiece

    from granary.llm.token_counts import MARK, counter

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [w for w in counter(path).vocabulary.whole if w[0] == MARK and MARK not in w[1:]]
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in library.encode([w[1:] for w in whole]))


def test_known_words_are_bounded(monkeypatch):
    from granary.llm import token_counts as m

    monkeypatch.setattr(m, "KEPT", 10)
    c = m.counter(tokenizer_file("piece_bpe_32k.model"))
    first = c.count(["zzqx vvkw ttrp"] * 2)
    assert c.count(["zzqx vvkw ttrp"]) == first[:1] and c.count(["zzqx"]) == c.count(["zzqx"])


def library_bpe():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), p.PATTERN


def test_byte_bpe(docs, empty):
    from granary.llm.byte_bpe import bpe_decode, bpe_encode

    library, pattern = library_bpe()
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(docs, path, pattern, ids=True)
    got = encoded.collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {bytes(r.decoded).decode() for r in bpe_decode(encoded, path, pattern).collect()} == {t or "" for t in TEXTS} | {"no id"}
    assert bpe_encode(empty, path, pattern).collect() == []


def test_byte_bpe_of_long_words_and_many_words():
    """Against the library: words that are encoded in pieces, and more new words than one query takes."""
    import random

    import public_tokenizers as p

    from granary.llm import byte_bpe as m

    library, pattern = library_bpe()
    e = m.Encoder(p.path("byte_bpe_multi_50k.tiktoken"), pattern)
    e.open()
    rng = random.Random(1)
    han = [chr(c) for c in range(0x4E00, 0x9FA5)]
    texts = [
        "a" * 20_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "".join(rng.choices("ACGT", k=30_000)), "".join(rng.choices(han, k=5_000)),
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=120)) for _ in range(2000)), "，".join("".join(rng.choices(han, k=20)) for _ in range(20_000)), "=" * 5000 + "\n" * 3000,
    ]
    parts = ["ab", "abc", "the", "x", "é", "日", "ing", "tion"]
    texts += ["".join(rng.choices(parts[: rng.randint(1, 8)], k=rng.randint(100, 1500))) for _ in range(60)]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert e.encode([t]) == [(len(ids), ",".join(map(str, ids)), t.encode())]
    e.close()


def test_byte_bpe_learns_frequent_words_once(monkeypatch):
    """Full tables of known words lose those that didn't come again, and no ids change; their bytes are bounded too."""
    import public_tokenizers as p

    from granary.llm import byte_bpe as m

    library, pattern = library_bpe()
    e = m.Encoder(p.path("byte_bpe_multi_50k.tiktoken"), pattern)
    e.open()
    learnt, learn = [], e.learn
    monkeypatch.setattr(m, "KEPT", 120)
    monkeypatch.setattr(e, "learn", lambda words: (learnt.extend(words), learn(words)))

    def check(text):
        ids = library.encode_ordinary(text)
        assert e.encode([text]) == [(len(ids), ",".join(map(str, ids)), text.encode())]
        return max(len(e.spaced_ids), len(e.plain_ids))

    often = [f"zzq{a}vvk" for a in "abcdefghij"]
    sizes = [check(" ".join(["x", *often, *(f"ww{chr(97 + i)}qx{chr(97 + j)}zk" for j in range(25)), "don't, and  so"][: 36 + i % 2])) for i in range(20)]
    assert max(sizes) <= 120 + 40 and all(learnt.count(" " + w) == 1 for w in often)
    monkeypatch.setattr(m, "HELD", 5_000)
    sizes = [check(" ".join(["x", *often, *(f"qz{chr(97 + i)}{chr(97 + j)}" * 20 for j in range(10))])) for i in range(8)]
    assert e.held < 5_000 + 10 * 600 and max(sizes[1:]) <= 60
    e.close()
    assert not e.spaced_ids and not e.again and not e.held


def test_byte_bpe_holds_a_word_once_and_opens_its_database_anew(monkeypatch):
    """Known words take few bytes each; the database, whose memory grows with its queries, is opened anew after some. Decoded bytes are those of the ids."""
    import tracemalloc

    import duckdb
    import pyarrow as pa
    import public_tokenizers as p

    from granary.llm import byte_bpe as m

    library, pattern = library_bpe()
    e = m.Encoder(p.path("byte_bpe_multi_50k.tiktoken"), pattern)
    opened, connect = [], duckdb.connect
    monkeypatch.setattr(duckdb, "connect", lambda *a, **k: (opened.append(1), connect(*a, **k))[1])
    words = [f"zq{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}vvk" for i in range(10_000)]
    text = "x " + " ".join(words)
    ids = library.encode_ordinary(text)
    e.open()
    tracemalloc.start()
    assert e.encode([text]) == [(len(ids), ",".join(map(str, ids)), text.encode())]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(e.spaced_ids) == len(words) and held < 165 * len(words)
    monkeypatch.setattr(m, "ROWS", 2_000)
    e.forget()
    assert e.encode([text])[0] == (len(ids), ",".join(map(str, ids)), text.encode())
    assert len(opened) > 2
    e.close()
    # A vocabulary that decodes to other bytes than it encodes: these bytes are what comes out, of known words too, alone or in pieces of several.
    told = e.tables["vocabulary"]
    odd = int(ids[-1])
    e.tables["vocabulary"] = pa.table({"id": told["id"], "bytes": ["21" if i == odd else b for i, b in zip(told["id"].to_pylist(), told["bytes"].to_pylist(), strict=True)]})
    e.open()
    own = {i: bytes.fromhex(b) for i, b in zip(*(e.tables["vocabulary"][c].to_pylist() for c in ("id", "bytes")), strict=True)}
    for t in (text, text, f"{words[-1]} {words[-1]},{words[-1]}", f"{words[-1]}  {words[-1]}"):
        ids = library.encode_ordinary(t)
        assert e.encode([t])[0] == (len(ids), ",".join(map(str, ids)), b"".join(own[i] for i in ids))
    e.close()


def test_byte_bpe_keeps_frequent_words_for_the_next_partition(spark, monkeypatch):
    """A worker's next partition doesn't encode again what the one before met twice; a resting worker holds no database and few words. No ids change."""
    import pyarrow as pa
    import public_tokenizers as p

    from granary.llm import byte_bpe as m

    library, pattern = library_bpe()
    e = m.Encoder(p.path("byte_bpe_multi_50k.tiktoken"), pattern)
    learnt, learn = [], e.learn
    monkeypatch.setattr(e, "learn", lambda words: (learnt.extend(words), learn(words)))
    monkeypatch.setattr(m, "encoder", lambda *_: e.open() or e)
    monkeypatch.setattr(m.common, "map_arrow", lambda df, run, added: run)
    run = m.bpe_encode(spark.createDataFrame([("",)], "text string"), "", "")
    often, seldom = [f"zzq{a}vvk" for a in "abcdefghij"], [f"qz{a}vvk" for a in "abcdefghij"]

    def partition(texts):
        for t, row in zip(texts, [r for b in run([pa.record_batch({"c0": [t]}) for t in texts]) for r in b.to_pylist()], strict=True):
            ids = library.encode_ordinary(t)
            assert (row["c1"], row["c2"], row["c3"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())

    partition(["x " + " ".join([*often, *seldom])])
    for _ in range(3):
        learnt.clear()
        partition(["x " + " ".join(often), "y, " + " ".join(often) + " don't"])
        assert e.db is None and len(e.spaced_ids) <= 12 and not e.plain_ids
    assert not {" " + w for w in often} & set(learnt)
    monkeypatch.setattr(m, "KEPT", 10)
    partition(["x " + " ".join(often)] * 2)
    assert len(e.spaced_ids) <= 5
    e.close()
    assert not e.spaced_ids


@pytest.mark.parametrize("piece", [4, 8, 16])
def test_byte_bpe_pieces_double(piece, monkeypatch):
    """Pieces too short for a cut, and words that need more rounds than one query has."""
    import public_tokenizers as p

    from granary.llm import byte_bpe as m

    library, pattern = library_bpe()
    monkeypatch.setattr(m, "ROWS", 300)
    e = m.Encoder(p.path("byte_bpe_multi_50k.tiktoken"), pattern)
    e.open()
    for word in ("international" * 9, "x" * 100, "abcdefgh" * 12):
        assert e.merge_long(word.encode(), piece).tolist() == library.encode_single_token(word) if word in e.whole else e.merge_long(word.encode(), piece).tolist() == library.encode_ordinary(word)
    e.close()


def test_decode_nulls(spark):
    from granary.llm.byte_bpe import bpe_decode

    df = spark.createDataFrame([(1, None), (2, []), (3, [72, None, 10_000_000, 73])], "k int, token_ids array<int>")
    got = {r.k: r.decoded for r in bpe_decode(df, tokenizer_file("byte_bpe_multi_50k.tiktoken"), library_bpe()[1]).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and len(got[3]) == 2


def test_media(docs, empty):
    from granary.llm.media import load, media_digests, store

    got = media_digests(docs).collect()
    for r in got:
        data = (r.text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(store(data)), hashlib.sha256(store(data)).hexdigest())
    assert len(got) == len(TEXTS) + 3 and media_digests(empty).collect() == []
    for size in (0, 63, 64, 65, 1 << 20, (1 << 20) + 1, 64 * 16385, 64 * 32771):
        data = np.random.default_rng(size).bytes(size)
        assert load(store(data))[1] == data.ljust(max(64, -(-size // 64) * 64), b"\0")


def read_back(media):
    """What a reader of the first file meets: transforms, and kinds of symbols."""
    met = set()
    real, kinds = webp._read_symbols, {webp.PREDICTOR: "predictor", webp.CROSS_COLOUR: "cross-colour", webp.PALETTE: "palette"}
    undo = {"unpredict": "predictor", "cross_colour": "cross-colour", "unpalette": "palette"}

    def watched(name):
        f = getattr(webp, name)

        def g(*a):
            met.add(undo[name])
            return f(*a)

        return g

    def symbols(r, width, height, codes, *others):
        if others[-1]:
            met.add("cache")
        if any(c.most > 1 for c in codes[0]):
            met.add("codes")
        if len({int(s) for s in codes[0][0].symbols if 256 <= s < 280}):
            met.add("references")
        return real(r, width, height, codes, *others)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(webp, "_read_symbols", symbols)
        m.setattr(webp, "_read_green", lambda r, width, height, codes: symbols(r, width, height, [codes], None, 0, 0).reshape(height, width))
        for name in undo:
            m.setattr(webp, name, watched(name))
        pixels = webp.decode(media)
    assert set(kinds.values()) == set(undo.values())
    return pixels, met


def test_media_uses_what_the_format_has():
    """On the query's path each feature is written for texts that it suits, and read again."""
    import random

    from granary.llm.media import load, store

    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)]
    prose = " ".join(rng.choice(words) for _ in range(20_000))
    digits = "".join(rng.choices("0123456789 ", k=900))
    rows = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=64)]
    for _ in range(200):  # a byte in five differs from the one above
        rows.append([x if rng.random() < 0.8 else rng.choice("abcdefghijklmnopqrstuvwxyz") for x in rows[-1]])
    steps = "".join(map("".join, rows))
    grey = "".join(chr(rng.randrange(33, 120)) * 3 + chr(rng.randrange(33, 120)) for _ in range(4000))
    wanted = {prose: {"codes", "cache", "references"}, prose[:2000]: {"codes", "references"}, digits: {"palette", "codes"}, "ab" * 500: {"palette", "references"}, steps: {"predictor", "cache"}, grey: {"cross-colour", "codes"}}
    for text, features in wanted.items():
        data = text.encode()
        _, met = read_back(store(data))
        assert load(store(data))[1] == data.ljust(-(-len(data) // 64) * 64, b"\0") and features <= met, (text[:20], met)
        assert len(store(data)) < 0.8 * len(data)


def test_webp_files_made_elsewhere():
    """A file that browsers are probed with: one transparent pixel. And one put together by hand: two groups of codes."""
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(one).tolist() == [[[0, 0, 0, 0]]]
    w = webp.Writer()
    for value, n in ((webp.SIGNATURE, 8), (8 - 1, 14), (1 - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):  # 8 x 1, no transform or cache, blocks of 4 pixels
        w.bits(value, n)

    def only(*symbols):
        w.bits(1, 1)
        w.bits(len(symbols) - 1, 1)
        w.bits(1, 1)
        for s in symbols:
            w.bits(s, 8)

    w.bits(0, 1)  # the image of group numbers: 0, 1, as green
    for symbols in ((0, 1), (0,), (0,), (255,), (0,)):
        only(*symbols)
    w.bits(0, 1)
    w.bits(1, 1)
    for symbols in ((10, 20), (1,), (2,), (255,), (0,), (30, 40), (3,), (4,), (128,), (0,)):
        only(*symbols)
    for bit in (0, 1, 1, 0, 1, 0, 0, 1):
        w.bits(bit, 1)
    got = webp.decode(webp.wrap(w.bytes()))[0].tolist()
    assert got == [[1, g, 2, 255] for g in (10, 20, 20, 10)] + [[3, g, 4, 128] for g in (40, 30, 30, 40)]


@pytest.mark.parametrize("predictor", [None, *range(14)])
@pytest.mark.parametrize("green", [False, True])
def test_webp_transforms(predictor, green):
    pixels = np.random.default_rng(1).integers(0, 3, (9, 13, 4), dtype=np.uint8) * 40
    for cross in (None, (3, -7, 90)):
        for cache in (0, 6):
            assert (webp.decode(webp.encode(pixels, cache, predictor, cross, green)) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 9, 200])
def test_webp_palettes(colours):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (11, 17))]
    assert (webp.decode(webp.encode(pixels, palette=True)) == pixels).all()
    assert (webp.decode(webp.encode(pixels, 0, 1, palette=True)) == pixels).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (40, 1), (7, 5)])
def test_webp_shapes(shape):
    pixels = np.random.default_rng(3).integers(0, 256, (*shape, 4), dtype=np.uint8)
    for predictor in (None, 1, 2, 11):
        assert (webp.decode(webp.encode(pixels, predictor=predictor)) == pixels).all()


@pytest.mark.parametrize("cache", [0, 1, 5])
def test_webp_large(cache, monkeypatch):
    rng = np.random.default_rng(4)
    pixels = np.concatenate([rng.integers(0, 256, (90, 16, 4), dtype=np.uint8), rng.integers(0, 3, (90, 16, 4), dtype=np.uint8), np.zeros((900, 16, 4), np.uint8)])
    assert (webp.decode(webp.encode(pixels, cache)) == pixels).all()
    pixels[..., 0], pixels[..., 2], pixels[..., 3] = 7, 8, 9  # of green alone: blocks of bits, against symbols one by one
    media = webp.encode(pixels, 0)
    assert (webp.decode(media) == pixels).all()
    for size in (1, 10, 1000):
        monkeypatch.setattr(webp, "BLOCK", size)
        assert (webp.decode(media) == pixels).all()
    monkeypatch.setattr(webp, "_read_green", lambda r, width, height, codes: webp._read_symbols(r, width, height, [codes], None, 0, 0))
    assert (webp.decode(media) == pixels).all()


def test_webp_damage(spark):
    from granary.llm.media import pixel_arrays

    good = webp.encode(np.random.default_rng(5).integers(0, 256, (2, 2, 4), dtype=np.uint8))
    for bad in (b"", b"RIFF", good[:20], good[:-30], b"X" * 60, webp.wrap(webp.chunks(good)[0][1][:-8])):
        with pytest.raises(webp.Corrupt):
            webp.decode(bad)
    large = webp.encode(np.zeros((200, 200, 4), np.uint8))
    df = spark.createDataFrame([(1, good, 5), (2, b"bad", 5), (3, None, 5), (4, large, 5)], "k int, media binary, width int")
    got = {r.k: (r.width, r.height, r.pixels) for r in pixel_arrays(df, largest=10_000).collect()}
    assert got[1][:2] == (2, 2) and len(got[1][2]) == 16 and got[2] == got[3] == got[4] == (None, None, None)


def test_language_id(spark):
    from granary.llm.language_id import predict_languages

    words = {"en": "the cat sat on the mat with this and that", "de": "der hund und die katze sind nicht im haus", "fr": "le chat est dans la maison avec les enfants"}
    training = spark.createDataFrame([(t, lang) for lang, t in words.items()] * 3 + [(None, "en"), ("words", None)], "text string, lang string")
    rows = [(1, "the cat and that", "x"), (2, "der hund und", None), (3, "les enfants", "y"), (4, None, "en"), (5, "", "en"), (6, "123 !!", "en"), (7, "the cat and that", "x")]
    got = {r.doc_id: r for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string, score string"), training).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[7].score
    none = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, score string"), training.where("false"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert predict_languages(spark.createDataFrame([], "text string"), training).collect() == []


def test_language_id_held_out(spark):
    from granary.llm.queries import op9_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in op9_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(held) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in held if truth[r.doc_id]]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_language_id_against_plain_bayes(spark):
    """Naive Bayes over n-grams, one by one, in dictionaries; hashing aside the same arithmetic."""
    import math
    import random

    from granary.llm import language_id as m

    rng = random.Random(5)
    alphabets = {"x": "aabcde", "y": "abbcdf", "z": "acdeeg"}
    training = [("".join(rng.choices(a + " ", k=200)), lang) for lang, a in alphabets.items() for _ in range(5)]

    def buckets(text):
        out = []
        for w in text.lower().split():
            own = m.grams([w])[0].tolist()
            text_of = f"\x02{w}\x03"
            assert len(own) == sum(max(0, len(text_of) - n + 1) for n in m.ORDERS)
            out += own
        return out

    counts = {lang: {} for lang in alphabets}
    for text, lang in training:
        for b in buckets(text):
            counts[lang][b] = counts[lang].get(b, 0) + 1
    sums = {lang: sum(c.values()) + 0.5 * m.BUCKETS for lang, c in counts.items()}
    texts = ["".join(rng.choices(rng.choice([*alphabets.values()]) + " ", k=rng.randint(1, 30))) + "a" for _ in range(40)] + ["abc " * 20_000, "abc", "abc"]
    got = m.predict_languages(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string"), spark.createDataFrame(training, "text string, lang string"))
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in got.collect():
        found = {lang: sum(math.log((c.get(b, 0) + 0.5) / sums[lang]) for b in buckets(r.text)) for lang, c in counts.items()}
        best = max(sorted(found), key=found.get)
        posterior = 1 / sum(math.exp(max(-700, v - found[best])) for v in found.values())
        assert r.lang_pred == best or abs(found[r.lang_pred] - found[best]) < 1e-3 * abs(found[best])
        assert abs(r.score - posterior) < 1e-2


def test_language_id_holds_no_document_without_an_id_out(spark, tmp_path):
    from granary.llm.queries import op9_language_id

    df = spark.createDataFrame([(None, "some words", "en", "s", 10), (1, "other words", "en", "s", 11), (1, "other words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
