"""Operators on words against brute force over the odd texts, and over copies in bulk."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from tests.llm.conftest import SCHEMA, sentences, texts
from tidemark.llm import near_dedup, packing, quality_rules, substring_dedup
from tidemark.llm.components import components, joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_substring(docs: dict[int, str | None], window: int) -> dict[int, tuple[int, int, str]]:
    words = {k: WORD.findall(t or "") for k, t in docs.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(odd: DataFrame, empty: DataFrame) -> None:
    for window, period in ((35, 21), (12, 7), (5, 3)):
        told = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.apply(odd, window, period, digest=True).collect()}
        assert told == brute_substring(texts(), window)
    assert substring_dedup.apply(empty).isEmpty()
    kept = {r.doc_id: r for r in substring_dedup.apply(odd, carry=("source", "score")).collect()}
    assert kept[4].kept_text == "" and kept[13].kept_text == "a\x00b c  d é Ü ß 日本語 🎉" and kept[2].source is None and kept[7].score == "z"


def test_substring_dedup_of_repeated_rows_and_null_ids(spark: SparkSession) -> None:
    base = sentences(9, 20)
    rows = [(1, base, None, None, None)] * 2 + [(None, sentences(10, 20), None, None, None), (None, sentences(11, 20), None, None, None)]
    told = substring_dedup.apply(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(told) == 4
    assert all((r.n_removed == r.n_words) == (r.doc_id == 1) for r in told)


def test_substring_dedup_tells_texts_of_one_id_apart(spark: SparkSession) -> None:
    shared, own = sentences(21, 9), sentences(22, 12)
    rows = [(1, shared), (2, shared), (1, own), (3, own + " x"), (4, sentences(23, 12))]
    told = substring_dedup.apply(spark.createDataFrame([(k, t, None, None, None) for k, t in rows[:3] + rows[4:]], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed > 0, r.n_words) for r in told) == sorted((k, t == shared, len(t.split())) for k, t in rows[:3] + rows[4:])
    told = substring_dedup.apply(spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)).collect()
    assert all((r.n_removed > 0) == (r.doc_id != 4) for r in told)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21])
def test_difference_covers(period: int) -> None:
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def brute_near(docs: dict[int, str | None], percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, t in docs.items():
        w = WORD.findall(lower(t or ""))
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    label = {k: k for k in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in docs}


def test_near_dedup(odd: DataFrame, empty: DataFrame) -> None:
    told = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.apply(odd).collect()}
    assert told == {k: (n, c, c == k) for k, (n, c) in brute_near(texts()).items()}
    assert near_dedup.apply(empty).isEmpty()


def test_near_dedup_of_a_large_family(spark: SparkSession) -> None:
    """Sixty edited copies with similarities on both sides of the threshold, and thirty exact ones."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(160)]
    docs = {}
    for k in range(60):
        words = base.copy()
        for at in rng.choice(160, k // 6, replace=False):
            words[at] = f"e{k}_{at}"
        docs[100 + k] = " ".join(words)
    docs |= {k: " ".join(base) for k in range(500, 530)}
    rows = [(k, t, None, "s", None) for k, t in docs.items()] + [(500, docs[500], None, "s", None), (None, docs[500], None, "s", None)]
    told = near_dedup.apply(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(told) == 92
    want = brute_near(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in told if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in told if r.doc_id is None] == [(None, True)]


def test_near_dedup_leaves_no_pair_of_a_bucket_out(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Copies with edits drawn from twenty common ones: each shares buckets with many others and links with few."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    edits = rng.random((100, 20)) < 0.5
    docs = {k: " ".join(f"{'e' if at % 8 == 4 and own[at // 8] else 'w'}{at}" for at in range(160)) for k, own in enumerate(edits)}
    reach = (edits[:, None] != edits[None]).sum(axis=2) <= 4  # each edit is in four of 157 shingles
    for _ in range(8):
        reach = reach.astype(np.float32) @ reach.astype(np.float32) > 0
    want = {k: (157, int(row.argmax())) for k, row in enumerate(reach)}
    assert 20 < len({c for _, c in want.values()}) < 95
    rows = spark.createDataFrame([(k, t, None, "s", None) for k, t in docs.items()], SCHEMA)
    told = near_dedup.apply(rows, near_dedup.Banding(pivots=1, chains=0))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in told.collect()} == want


def test_components_of_chains_and_stars(spark: SparkSession) -> None:
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    told = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert told == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 130)}


def test_components_joined_by_more_links(spark: SparkSession) -> None:
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (21, 30), (40, 41), (5, 40)]
    tables = [spark.createDataFrame(x, "a long, b long") for x in (first, more, first + more)]
    told = {tuple(r) for r in joined(components(tables[0]), tables[1]).collect()}
    assert told == {tuple(r) for r in components(tables[2]).collect()}


def brute_rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, sum(hit), n < 10 or 100 * sum(hit) > 20 * n


def test_quality_base_rules(odd: DataFrame, empty: DataFrame) -> None:
    told = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply(odd).collect()}
    assert told == {k: brute_rules(t) for k, t in texts().items()}
    assert quality_rules.apply(empty).isEmpty()


def test_boilerplate_goes_and_copies_do_not_count(spark: SparkSession) -> None:
    """A banner on thirty pages of one host is boilerplate there; thirty exact or near copies of one page are not."""
    rows = [(k, f"{sentences(k, 3)}\nAll  Rights reserved\n{sentences(1000 + k, 3)}", None, "a", None) for k in range(30)]
    rows += [(100 + k, sentences(77, 6), None, "a", None) for k in range(30)]
    near = [sentences(78, 30).split("\n") for _ in range(60)]
    for k, lines in enumerate(near):
        lines[k % 30] += f" edit{k}"
    rows += [(300 + k, "\n".join(lines), None, "a", None) for k, lines in enumerate(near)]
    rows += [(200, "all rights RESERVED\n" * 3 + "one two three four five six seven eight nine ten\none more", None, "a", None), (201, "All rights reserved\none two", None, "b", None)]
    rows += [(202, "All rights reserved\nx y z", None, "a", None)] * 2 + [(None, "All rights reserved\nx y", None, "a", None)]
    table = spark.createDataFrame(rows, SCHEMA)
    told = {r.doc_id: r for r in quality_rules.apply(table).collect()}
    assert all(told[k].n_lines_removed == 1 and told[k].n_line_words == 3 and told[k].kept for k in range(30))
    assert all(told[k].n_lines_removed == 0 and told[k].kept for k in [*range(100, 130), *range(300, 360)])
    assert (told[200].n_lines_removed, told[200].n_line_words) == (1, 9)
    assert told[201].n_lines_removed == 0
    assert told[202].depleted and told[202].n_line_words == 3 and told[None].depleted
    texts_ = {r[0]: r[1] for r in rows}
    kept = {r.doc_id: r.kept_text for r in quality_rules.cleaned(table).collect()}
    assert all(kept[k] == texts_[k].replace("\nAll  Rights reserved", "") for k in range(30))
    assert all(kept[k] == texts_[k] for k in [*range(100, 130), *range(300, 360), 201])
    assert kept[200] == "one two three four five six seven eight nine ten\none more" and kept[202] == "x y z"


def test_footers_of_several_lines_and_repeated_rows(spark: SparkSession) -> None:
    """Every line of a footer goes; repeats of one row neither add to the documents of a line nor hide it."""
    footer = "contact us by mail\nsome rights reserved here\nback to the top"
    rows = [(k, f"body {k} of page {k}\nwith words {k} own{k} more{k}\n{footer}", None, "a", None) for k in range(60)]
    assert [r.n_lines_removed for r in quality_rules.apply(spark.createDataFrame(rows, SCHEMA)).collect()] == [3] * 60
    rows = [(k, f"{sentences(k, 2)}\nshared line of all", None, "a", None) for k in range(30)]
    told = quality_rules.apply(spark.createDataFrame(rows + rows[:1] * 60, SCHEMA)).collect()
    assert len(told) == 90 and {r.n_lines_removed for r in told} == {1}
    told = quality_rules.apply(spark.createDataFrame(rows[:15] * 6, SCHEMA)).collect()
    assert {r.n_lines_removed for r in told} == {0}


def check_packing(rows: list, docs: list[str | None], capacity: int) -> int:
    tokens = packing.encoding(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert sum(r.length for r in rows) == sum(len(tokens.encode_ordinary(t or "")) + 1 for t in docs)
    by: dict[int, list] = {}
    for r in rows:
        assert 1 <= r.length <= capacity
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(odd: DataFrame, empty: DataFrame) -> None:
    docs = texts()
    for capacity in (1024, 64, 2):
        rows = packing.apply(odd, capacity).collect()
        n = check_packing(rows, list(docs.values()), capacity)
        assert n <= -(-sum(r.length for r in rows) // capacity) * 1.1 + 3
        for doc in {r.doc_id for r in rows}:
            own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == doc)
            assert [p for p, _, _ in own] == list(range(len(own)))
            assert all(length == capacity for _, _, length in own[1:])
            assert all(own[k + 1][1] == own[k][1] + own[k][2] for k in range(len(own) - 1))
    assert packing.apply(empty).isEmpty()


def test_ids_are_those_of_the_tokenizers_file() -> None:
    from tokenizers import Tokenizer

    own, other = packing.encoding(packing.public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    for text in filter(None, texts().values()):
        assert own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_ids_of_texts_with_the_added_token(spark: SparkSession) -> None:
    """Pieces hold the ids of the tokenizers file where a text spells its added token."""
    import zlib

    from tokenizers import Tokenizer

    other = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    docs = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  \n b", "<|endoftext", "é<|endoftext|>日本", "<|ENDOFTEXT|>", "x <|endoftext|>\n" * 90]
    want = []
    for k, text in enumerate(docs):
        ids = [*other.encode(text, add_special_tokens=False).ids, packing.END_ID]
        want += [(k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())) for start, length in packing.cut(len(ids), 64)]
    told = packing.apply(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(docs)], SCHEMA), 64)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in told.collect()) == sorted(want)


def test_two_fit_improves_on_greedy() -> None:
    """Greedy takes 6 and 3 of 10; the 3 gives way to 2 + 2, which fill the sequence."""
    counts = np.zeros(10, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.patterns(counts, 10)[0] == ([6, 2, 2], 1)
    assert packing.two_fit(np.array([0, 0, 1, 0, 0]), 4) == (0, 0)
    assert packing.two_fit(np.array([0, 0, 2, 0, 0]), 4) == (2, 2)


def test_patterns_use_every_piece() -> None:
    counts = np.random.default_rng(1).integers(0, 50, 256)
    counts[0] = 0
    found = packing.patterns(counts, 256)
    used = np.zeros(256, np.int64)
    for bin_, many in found:
        assert sum(bin_) <= 256
        np.add.at(used, bin_, many)
    assert (used == counts).all()
    assert sum(many for _, many in found) <= -(-(counts * np.arange(256)).sum() // 256) * 1.01 + 1


def test_shuffled_joins_give_the_same_rows(odd: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    """The way beyond the broadcast limits."""
    from tidemark.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    told = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.apply(odd, 12, 7, digest=True).collect()}
    assert told == brute_substring(texts(), 12)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.apply(odd).collect()} == brute_near(texts())
    assert check_packing(packing.apply(odd, 64).collect(), list(texts().values()), 64)
