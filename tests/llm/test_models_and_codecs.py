"""SentencePiece, token counts, media columns and the three learned operators."""

from __future__ import annotations

import collections
import hashlib
import io
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession

from tests.llm.conftest import SCHEMA, sentences, texts
from tidemark.llm import language_id, media, packing, quality_classifier, sentencepiece_codec, token_counts, toxicity
from tidemark.llm.shared import crc_fold
from tidemark.llm.words import buffers

MODEL = sentencepiece_codec.public_tokenizers.path("piece_bpe_32k.model")


def unigram_library():
    """The library over the same pieces, told to segment by unigram scores."""
    import sentencepiece

    raw = bytearray(open(MODEL, "rb").read())
    at = raw.find(b"\x18\x02\x20")  # trainer_spec.model_type, the field before vocab_size
    raw[at + 1] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def encoded(values: list[str | None]) -> list[list[int]]:
    ids, bounds = sentencepiece_codec.encode_slice(*buffers(pa.array(values, pa.string())), sentencepiece_codec.vocabulary(MODEL))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_viterbi_equals_the_lattice_of_the_library() -> None:
    """Word by word the same path or a tie; over long texts the library sums in single precision, and is never better."""
    library, vocab = unigram_library(), sentencepiece_codec.vocabulary(MODEL)
    words = sorted({w for t in texts().values() if t for w in t.split()} | {"日本語🎉", "é" * 40, "naïve", "café", "x" * 70, "the", "with", "other"})
    for text, ids in zip(words, encoded(words), strict=True):
        best = library.nbest_encode(text, nbest_size=2)[0]
        assert ids == best or sum(vocab.scores[k] for k in ids) == pytest.approx(sum(vocab.scores[k] for k in best), abs=0.5)
    values = [*filter(None, (t and t[:400] for t in texts().values())), " a  b "]
    for text, ids in zip(values, encoded(values), strict=True):
        best = library.nbest_encode(text, nbest_size=2)[0]
        assert sum(vocab.scores[k] for k in ids) >= sum(vocab.scores[k] for k in best)
        assert library.decode(ids) == text == sentencepiece_codec.decode(ids, vocab)


def full_table(text: bytes, vocab: sentencepiece_codec.Vocabulary, pieces: dict[bytes, tuple[int, float]]) -> list[int]:
    """A whole-text Viterbi with all backpointers, piece by piece; of equal sums the longest last piece wins."""
    best, back = {0: 0.0}, {}
    for end in range(1, len(text) + 1):
        if end < len(text) and text[end] & 0xC0 == 0x80:
            continue
        for start in range(max(0, end - max(vocab.longest, 4)), end):
            if start not in best:
                continue
            part, own = text[start:end], pieces.get(text[start:end])
            one = len(part.decode("utf-8", "ignore")) == 1 and part[0] & 0xC0 != 0x80
            if own is None and not one:
                continue
            total = best[start] + (own[1] if own else vocab.penalty)
            if end not in best or total > best[end] + 1e-9:
                best[end], back[end] = total, (start, [own[0]] if own else vocab.spelled(part))
    at, out = len(text), []
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_stream_in_bounded_memory_equals_the_full_table(monkeypatch: pytest.MonkeyPatch) -> None:
    """Chunks of any size, cut inside characters too, give the ids of the full table; the window stays small."""
    vocab, rng = sentencepiece_codec.vocabulary(MODEL), random.Random(4)
    pieces = {}
    for k, (text, piece) in enumerate(zip(vocab.texts, vocab.pieces, strict=True)):
        if text and k > 2 and k not in set(vocab.byte_ids.tolist()):
            pieces.setdefault(piece.replace(sentencepiece_codec.MARK, b" "), (k, vocab.scores[k]))
    for text in [*filter(None, (t and t[:600] for t in texts().values())), "x" * 300 + "日本é🎉" * 30, "  a   b", "thethethe" * 60]:
        stream, raw, out, at = sentencepiece_codec.Stream(vocab), (" " + text).encode(), [], 0
        while at < len(raw):
            step = rng.randint(1, 40)
            out += stream.feed(raw[at : at + step])[0].tolist()
            at += step
            assert len(stream.best) <= vocab.longest + 1 and len(stream.tail) <= vocab.longest
        early = len(out)
        out += stream.close()[0].tolist()
        assert out == full_table(raw, vocab, pieces)
        assert [out] == encoded([text])
        if len(raw) > 300 and " " in text:  # a period without spaces may keep its alignments apart for ever
            assert early > 0.5 * len(out) and len(stream.origin) < len(raw) / 2
    long = sentences(8, 400).replace("\n", "")
    whole = encoded([long, long.replace(" ", "")])
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 64)
    assert encoded([long, long.replace(" ", "")]) == whole


def test_sentencepiece_round_trip(odd: DataFrame, empty: DataFrame) -> None:
    told = {r.doc_id: r for r in sentencepiece_codec.apply(odd).collect()}
    assert all(r.round_trip for r in told.values())
    assert told[4].n_ids == told[5].n_ids == 0
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_ids(sentencepiece_codec.encode(odd)).collect()}
    assert back == {k: t or "" for k, t in texts().items()}
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode(odd).collect()}
    assert all(zlib.crc32(np.array(ids[k], "<u4").tobytes()) == r.ids_crc32 for k, r in told.items())
    assert sentencepiece_codec.apply(empty).isEmpty()


def brute_owner(spans: list[tuple[int, int]], sections: list[tuple[int, int]]) -> list[int]:
    counts = [0] * len(sections)
    for a, b in spans:
        shares = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        if max(shares, default=0) > 0:
            counts[shares.index(max(shares))] += 1
    return counts


def test_attribution_against_brute_force() -> None:
    rng = random.Random(5)
    for _ in range(300):
        ends = np.cumsum([rng.randint(1, 5) for _ in range(rng.randint(0, 30))]).astype(np.int64)
        total, sections, at = int(ends[-1]) if len(ends) else 0, [], 0
        while at < total:
            at += rng.choice([0, 0, 1, 3])
            stop = at + rng.randint(1, 9)
            sections.append((at, stop))
            at = stop
        if not sections:
            sections = [(0, 1)]
        starts, stops = (np.array(x, np.int64) for x in zip(*sections, strict=True))
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False))[: len(ends)]
        counts, crossing = token_counts.attribute(ends, starts, stops)
        assert counts.tolist() == brute_owner(spans, sections)
        inside = sum(any(x <= a and b <= y for x, y in sections) for a, b in spans)
        touching = sum(any(max(0, min(b, y) - max(a, x)) for x, y in sections) for a, b in spans)
        assert crossing == touching - inside


def test_token_counts(odd: DataFrame, empty: DataFrame) -> None:
    tokens = packing.encoding(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in token_counts.by_lines(odd).collect():
        text = texts()[r.doc_id] or ""
        assert r.n_tokens == len(tokens.encode_ordinary(text)) == sum(r.section_tokens)
        assert r.n_sections == max(1, text.count("\n") + (not text.endswith("\n"))) == len(r.section_tokens)
    assert token_counts.by_lines(empty).isEmpty()
    fields = token_counts.by_fields(odd, "doc_id", ["source", "lang", "text"]).collect()
    assert len(fields) == len(texts())
    for r in fields:
        assert sum(r.field_tokens) <= r.n_tokens
        assert (r.field_tokens[2] > 0) == bool(texts()[r.doc_id])


def test_media_read_back(odd: DataFrame, empty: DataFrame) -> None:
    stored = {r.doc_id: bytes(r.media) for r in media.store(odd).collect()}
    for r in media.apply(odd).collect():
        raw = (texts()[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        square = [np.load(io.BytesIO(bytes(t))) for t in r.tiles]
        assert [x.shape for x in square] == [(media.TILE, media.TILE)] * 4
        whole = np.block([square[:2], square[2:]])
        if image.shape[0] <= 200:
            assert np.abs(slow_area(image, media.SIDE, media.SIDE) - whole).max() <= 0.5 + 1e-6
        assert r.feature == "".join(r.tile_hashes) == "".join(slow_hash(x) for x in square)
    assert {m[:2] for m in stored.values()} == {b"P5"}
    other = {r.doc_id: r for r in media.apply(odd, "bmp").collect()}
    for r in media.apply(odd).collect():
        same = other[r.doc_id]
        assert (same.payload_sha256, same.feature, same.tiles) == (r.payload_sha256, r.feature, r.tiles) and same.media_sha256 != r.media_sha256
    assert media.apply(empty).isEmpty()


def slow_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages with one overlap matrix an axis."""

    def overlaps(n: int, cells: int) -> np.ndarray:
        edge, step = np.arange(n), n / cells
        return np.array([np.clip(np.minimum(edge + 1, (k + 1) * step) - np.maximum(edge, k * step), 0, None) / step for k in range(cells)])

    return overlaps(image.shape[0], height) @ image @ overlaps(image.shape[1], width).T


def slow_hash(tile: np.ndarray) -> str:
    grid = slow_area(tile.astype(float), 8, 9)
    bits = "".join(str(int(round(grid[y, x], 6) < round(grid[y, x + 1], 6))) for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


def test_broken_media_give_nulls(spark: SparkSession) -> None:
    rows = [(1, 3, b"P5\n64 9\n255\nshort"), (2, 1, b"??"), (3, 1, None), (4, 0, b"BM"), (5, 0, b"P5")]
    told = media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert len(told) == 5 and all(r.payload_sha256 is None and r.feature is None for r in told)


def test_netpbm_and_bmp_forms() -> None:
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    bits = (gray % 3 == 0).astype(np.uint8)
    assert (media.decode(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % v for v in gray.ravel())) == gray).all()
    assert (media.decode(b"P5\n# note\n4 3 255\n" + gray.tobytes()) == gray).all()
    assert (media.decode(b"P5 4 3 65535\n" + gray.astype(">u2").tobytes()) == gray).all()
    assert (media.decode(b"P3 4 3 255 " + b" ".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    assert (media.decode(b"P6 4 3 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P1 4 3\n" + b"".join(b"%d" % v for v in bits.ravel())) == bits).all()
    assert (media.decode(b"P4 4 3\n" + np.packbits(bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    odd = np.arange(15, dtype=np.uint8).reshape(3, 5)
    assert (media.decode(media.encode_bmp(odd)) == odd).all()
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 4, -3, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (media.decode(head + rgb[:, :, ::-1].tobytes()) == rgb).all()


def test_area_resize_is_exact() -> None:
    image = np.random.default_rng(0).integers(0, 255, (6, 9)).astype(np.uint8)
    assert np.allclose(media.resize_area(image, 2, 3), image.reshape(2, 3, 3, 3).mean(axis=(1, 3)))
    assert np.allclose(media.resize_area(image, 6, 9), image)
    assert media.resize_area(image, 4, 5).mean() == pytest.approx(image.mean())
    up = media.resize_area(np.array([[0, 8]], np.uint8), 8, 4)
    assert np.allclose(up, [[0, 0, 8, 8]] * 8)
    assert [(y, x) for y, x, *_ in media.tiles(image, 4)] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


LANGUAGES = {"aa": "the of and tion ing er re", "bb": "sch ung keit ein ver und lich", "cc": "ción que mente ado los é ñ"}


def speech(lang: str, seed: int) -> str:
    rng, parts = random.Random(seed), LANGUAGES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120)))


def test_language_id_on_held_out_rows(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:
    langs = list(LANGUAGES)
    rows = [(k, speech(langs[k % 3], k), langs[k % 3] if crc_fold(k, 5) else "zz", "s", None) for k in range(240)]
    told = {r.doc_id: r for r in language_id.apply(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [k for k in told if told[k].held_out]
    assert held and all(crc_fold(k, 5) == 0 for k in held)
    assert np.mean([told[k].lang_pred == langs[k % 3] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in told.values()) and "zz" not in {r.lang_pred for r in told.values()}
    found = {r.doc_id: r for r in language_id.apply(odd).collect()}
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {4, 5, 6, 20}
    assert language_id.apply(empty).isEmpty()
    unlabelled = language_id.apply(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_table_scores_equal_convolution() -> None:
    rng = np.random.default_rng(1)
    net = language_id.train(rng.integers(0, 255, (40, 32)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], language_id.Settings(window=32, epochs=2))
    x = rng.integers(0, 255, (7, 32)).astype(np.uint8)
    shown = net.embed[x]
    pooled = [sum(shown[:, k : 32 - len(w) + 1 + k] @ w[k] for k in range(len(w))).max(axis=1) for w in net.filters]
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.offset
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(language_id.Scorer(net).windows(x), want, atol=1e-5)


def labelled(spark: SparkSession, docs: dict[int, str], name: str, marks: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    frame = spark.createDataFrame([(k, t, "aa", "s", None) for k, t in docs.items()], SCHEMA)
    return frame, spark.createDataFrame(list(marks.items()), f"doc_id long, {name} int")


def test_quality_classifier_on_held_out_rows(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:
    docs = {k: sentences(k, 12) if k % 3 else " | ".join(sentences(k, 6).upper().split()) for k in range(240)}
    frame, labels = labelled(spark, docs, "quality", {k: int(k % 3 > 0) for k in docs})
    told = {r.doc_id: r for r in quality_classifier.apply(frame, labels).collect()}
    held = [k for k in docs if told[k].held_out]
    assert np.mean([told[k].predicted == int(k % 3 > 0) for k in held]) > 0.95
    more = quality_classifier.apply(odd, labels).collect()
    assert len(more) == len(texts()) and all(0 <= r.score <= 1 for r in more)
    assert quality_classifier.apply(empty, labels).isEmpty()


def test_attention_gradients() -> None:
    rng = np.random.default_rng(2)
    x, bounds, y = rng.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    layers = {"encode": rng.normal(size=(5, 4)), "shift": rng.normal(size=4), "value": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "focus": rng.normal(size=3), "score": rng.normal(size=4), "base": np.zeros(1)}

    def loss() -> float:
        p, _ = quality_classifier.forward(x, bounds, layers)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    p, kept = quality_classifier.forward(x, bounds, layers)
    assert np.allclose(np.add.reduceat(kept["attention"], bounds[:-1]), 1)
    for name, grad in quality_classifier._gradient(x, bounds, layers, p - y, kept).items():
        flat, want = layers[name].reshape(-1), grad.reshape(-1)
        for k in range(len(flat)):
            flat[k] += 1e-6
            up = loss()
            flat[k] -= 2e-6
            down = loss()
            flat[k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(want[k], abs=1e-4)


def test_toxicity_plain_and_disguised(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:
    bad, docs = ["wretched", "blighter", "scoundrel"], {}
    for k in range(400):
        words = speech("aa", k).split()
        if k % 4 == 0:
            words[5:5] = [bad[k // 4 % 3], bad[k // 4 % 2]]
        docs[k] = " ".join(words)
    frame, labels = labelled(spark, docs, "toxic", {k: int(k % 4 == 0) for k in docs})
    told = {r.doc_id: r for r in toxicity.apply(frame, labels).collect()}
    held = [k for k in docs if told[k].held_out]
    assert held and all(crc_fold(k, 3) == 1 for k in held)
    assert np.mean([told[k].predicted == int(k % 4 == 0) for k in held]) > 0.97
    tricks = ["wr3tch3d bl1ght3r", "w r e t c h e d s c o u n d r e l", "w.r.e.t.c.h.e.d blight-e-r b.l.i.g.h.t.e.r", "wretcheeeed blllllighter", "SC0UNDR3L!!! WR3TCH3D"]
    model = toxicity.fit(frame, labels)
    disguised = spark.createDataFrame([(k, f"the of and {t} tion ing", None, None, None) for k, t in enumerate(tricks)], SCHEMA)
    assert [r.predicted for r in toxicity.predict(disguised, model).selectExpr("doc_id", "int(score >= 0.7) predicted").orderBy("doc_id").collect()] == [1] * len(tricks)
    more = toxicity.predict(odd, model).collect()
    assert len(more) == len(texts()) and all(0 <= r.score < 0.7 for r in more)
    assert toxicity.apply(empty, labels).isEmpty()
    blank = toxicity.apply(odd, labels.where("false")).collect()
    assert all(r.predicted == 0 for r in blank)


def test_toxicity_learns_from_all_labelled_documents(spark: SparkSession) -> None:
    """More documents than any bound of a sample: trigrams, evidence and its log odds are those of plain counts over all."""
    pick, rng = random.Random(11), np.random.default_rng(11)
    words = ["".join(pick.choice("abdeghiknorstu") for _ in range(pick.randint(3, 7))) for _ in range(400)]
    bad = ["wretched", "blighter", "scoundrel"]
    docs = {k: " ".join(pick.choice(words) for _ in range(8)) + (f" {bad[k % 3]}" if k % 10 == 0 else "") for k in range(16_500)}
    docs |= {k: " ".join(words[:40]) + " wretched" for k in range(16_500, 16_530)} | {k: " ".join(words[:39]) + f" more{k} wretched" for k in range(16_530, 16_560)}
    toxic = {k: int(k % 10 == 0 or k >= 16_500) for k in docs}
    frame, labels = labelled(spark, docs, "toxic", toxic)
    ids = [k for k in docs if crc_fold(k, 3) != 1]
    frame = frame.unionByName(spark.createDataFrame([(ids[0], docs[ids[0]] + " zz", None, None, None)] * 5, SCHEMA))  # the smallest text of an id counts
    rows = {r.doc_id: r for r in toxicity.learned(frame, labels).collect()}
    # each large group counts once, a near copy is similar to the first one
    first, similar = next(k for k in ids if k >= 16_500), [k for k in ids if k >= 16_500]
    want = sorted(set(ids) - set(similar) | {first})
    assert len(want) > 10_000 and sorted(rows) == want and all(rows[k].text == docs[k] and rows[k].toxic == toxic[k] for k in want)

    tokens = toxicity.Tokens(*buffers(pa.array([docs[k] for k in want])))
    n, hits = collections.Counter(), collections.Counter()
    pairs = {(f, d) for values in tokens.features() for f, d in zip(values.tolist(), tokens.document.tolist(), strict=True) if f}
    n.update(f for f, _ in pairs)
    hits.update(f for f, d in pairs if toxic[want[d]])
    usual, odds = sum(toxic[k] for k in want) / len(want), {}
    for f in n:
        share = (hits[f] + 2 * usual) / (n[f] + 2)
        ratio = hits[f] * np.log(share / usual) + (n[f] - hits[f]) * np.log((1 - share) / (1 - usual))
        if hits[f] >= 2 and share > 2 * usual and ratio > 9:
            odds[f] = np.log(share / (1 - share)) - np.log(usual / (1 - usual))
    model = toxicity.fit(frame, labels)
    assert len(odds) >= 3 and model.features.tolist() == sorted(odds) and model.weights == pytest.approx([odds[f] for f in sorted(odds)])
    assert np.array_equal(model.trigrams, toxicity.costs(toxicity._trigram_counts(tokens.data, tokens.starts, tokens.ends)))

    x = np.concatenate([np.ones((500, 1)), rng.normal(size=(500, 4))], axis=1)
    y = (rng.random(500) < 1 / (1 + np.exp(-x @ [-1, 2, 0, 0.5, -1]))).astype(int)
    beta = toxicity.calibrate(spark.createDataFrame([(int(b), a.tolist(), 1) for a, b in zip(x, y, strict=True)], "toxic int, x array<double>, n long").repartition(5), 0.5)
    assert x.T @ (y - 1 / (1 + np.exp(-x @ beta))) == pytest.approx(np.array([1e-6, 0.5, 0.5, 0.5, 0.5]) * beta, abs=1e-5)


def slow_restore(text: str, trigrams: np.ndarray, cost: float) -> tuple[float, set[str]]:
    """The least cost over all readings of a lattice, and the readings that have it."""
    costs = {}
    for path in itertools.product(*toxicity.lattice(text)):
        told, total = "".join(p for p, _ in path), cost * sum(t for _, t in path)
        words = told.split()
        for word in words:
            classes = [27, 27, *(ord(c) - 97 if "a" <= c <= "z" else 26 for c in word), 27]
            total += sum(trigrams[classes[k], classes[k + 1], classes[k + 2]] for k in range(len(classes) - 2))
        costs[" ".join(words)] = min(total, costs.get(" ".join(words), 1e9))
    least = min(costs.values())
    return least, {t for t, c in costs.items() if c <= least + 1e-9}


def test_lattice_decoding_against_all_readings() -> None:
    rng = np.random.default_rng(3)
    decoder = toxicity.Decoder(-np.log(rng.dirichlet(np.ones(28), (28, 28))), 1.0)
    pick = random.Random(7)
    for _ in range(150):
        text = "".join(pick.choice("abdiot01375$@.- -") for _ in range(pick.randint(1, 8))).strip(" .-") or "x"
        told, _ = decoder.best(text)
        assert " ".join(told.split()) in slow_restore(text, np.array(decoder.table), 1.0)[1]


def test_disguised_runs_of_any_length() -> None:
    words = [*"the that thing idiot stupid is an and you are well known mail with this that have was in of to for".split() * 20, *["a"] * 200, *["i"] * 100]
    plain = toxicity.Tokens(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    decoder = toxicity.Decoder(toxicity.costs(toxicity._trigram_counts(plain.data, plain.starts, plain.ends)), 1.0)

    def restored(text: str) -> list[str]:
        raw = text.encode()
        return toxicity.restored(toxicity.Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), decoder)[1]

    hidden = ["id.iot", "i-d iot", "i d i o t", "1d107", "i...d...i...o...t", "iddiioott", "idi" + "o" * 300 + "t", "(i_d_i_o_t)", "!d!ot"]
    assert {x: restored(x) for x in hidden} == {x: ["idiot"] for x in hidden}
    assert restored("a i d i o t") == ["a idiot"] and restored("I s t u p i d") == ["i stupid"] and restored("you are an i d iot") == ["an idiot"]
    assert restored("the well-known thing that i have in a mail") == []
    long = "1d10t-" * 20_000
    assert restored(long)[0].split()[:3] == ["idiot"] * 3
    assert restored("") == restored(" . - ") == []


def test_samples_are_bounded_by_rows_whatever_repeats(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """One id on 500 rows is one row of a sample."""
    seen = []
    monkeypatch.setattr(language_id, "train", lambda windows, labels, *a: seen.append(len(labels)))
    monkeypatch.setattr(quality_classifier, "train", lambda bags, *a: seen.append(len(bags)))
    rows = [(1, "some words here", "aa", "s", None)] * 500 + [(k, "some words here", "aa", "s", None) for k in range(2, 100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1)] * 30 + [(k, k % 2, k % 2) for k in range(2, 100)], "doc_id long, quality int, toxic int")
    language_id.fit(frame, language_id.Settings(max_rows=40))
    quality_classifier.fit(frame, labels, quality_classifier.Settings(max_rows=40))
    assert seen == [40, 40]
    assert toxicity.fit(frame, labels, toxicity.Settings(max_rows=40)).trigrams.shape == (28, 28, 28)


def test_windows_cover_texts_and_documents_weigh_them_by_bytes(odd: DataFrame) -> None:
    rng = np.random.default_rng(1)
    net = language_id.train(rng.integers(0, 255, (40, 64)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], language_id.Settings(window=64, epochs=1))
    scorer = language_id.Scorer(net)
    for r in language_id.predict(odd, net, language_id.Settings(window=64)).collect():
        raw = (texts()[r.doc_id] or "").encode()
        parts = [raw[k : k + 64] for k in range(0, len(raw), 64)]
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in raw.decode())
            continue
        each = scorer.windows(np.stack([np.frombuffer(p.ljust(64, b"\0"), np.uint8) for p in parts]))
        mean = np.average(each, axis=0, weights=[len(p) for p in parts])
        assert (r.lang_pred, r.score) == ("ab"[mean.argmax()], pytest.approx(mean.max(), abs=1e-6))


def test_passages_and_scores_document_by_document(odd: DataFrame) -> None:
    """A slice of documents gives what each gives alone."""
    rng = np.random.default_rng(4)
    docs = [t or "" for t in texts().values()]
    data, offsets = buffers(pa.array(docs))
    x, bounds = quality_classifier.encode(data, offsets, 64)
    assert np.diff(bounds).tolist() == [max(1, -(-len(language_words(t)) // 64)) for t in docs]
    model = quality_classifier.train([rng.normal(size=(3, x.shape[1])) for _ in range(8)], np.arange(8) % 2.0, quality_classifier.Settings(epochs=1))
    told = {r.doc_id: r.score for r in quality_classifier.predict(odd, model).collect()}
    for k, text in texts().items():
        alone, edges = quality_classifier.encode(*buffers(pa.array([text or ""])), 64)
        assert np.allclose(alone, x[bounds[k] : bounds[k + 1]])
        score, _ = quality_classifier.forward(np.clip((alone - model.mean) / model.scale, -8, 8), edges, model.layers)
        assert told[k] == pytest.approx(float(score[0]), abs=1e-9)


def language_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_repeated_rows_get_equal_rows(spark: SparkSession) -> None:
    """Three rows of each id: every operator that judges rows alone tells the same of all three."""
    rows = [(k, t, "aa" if k % 2 else "bb", "s", None) for k, t in texts().items() if k < 12] * 3
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    for told in (
        sentencepiece_codec.apply(frame), token_counts.by_lines(frame), language_id.apply(frame), media.apply(frame), quality_classifier.apply(frame, labels), toxicity.apply(frame, labels),
    ):
        found = told.toPandas()
        assert len(found) == 36 and found["doc_id"].value_counts().eq(3).all()
        assert found.round(9).astype(str).drop_duplicates().shape[0] == 12
    pieces = packing.apply(frame).toPandas()
    assert pieces.groupby(["doc_id", "piece"]).size().eq(3).all() and not pieces.duplicated(["sequence_id", "offset"]).any()
