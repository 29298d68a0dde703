"""Line dedup, quality rules, token counts, SentencePiece and mixing against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from corpusloom.llm import line_dedup, mixing, pieces, quality, token_counts
from corpusloom.llm.common import SPACE

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(UPPER)


def deduped(rows, least, keep="none"):
    """text by (doc_id, text)."""
    holders = defaultdict(set)
    for d, t in rows:
        for k in map(key, (t or "").split("\n")):
            holders[k].add((d, t))
    hot = {k for k, v in holders.items() if k and len(v) >= least}
    return {(d, t): "\n".join(x for x in (t or "").split("\n") if key(x) not in hot) for d, t in rows}


@pytest.mark.parametrize("least", [1, 2, 10])
def test_lines_found_in_many_documents_go(spark, documents, corpus, least):
    want, holders = deduped([r[:2] for r in corpus], least), defaultdict(set)
    for d, t in {r[:2] for r in corpus}:
        for k in map(key, (t or "").split("\n")):
            holders[k].add((d, t))
    got = line_dedup.with_bitmaps(documents, least).select("doc_id", "text", "n_covered", "bitmap", "n_dropped").collect()
    assert len(got) == len(corpus)
    for r in got:
        text, n = line_dedup.kept_text(r.text, r.n_covered, r.bitmap)
        assert text == want[(r.doc_id, r.text)] and n == len((r.text or "").split("\n"))
        assert (r.n_dropped or 0) == sum(len(holders[key(x)]) >= least for x in (r.text or "").split("\n") if key(x))


def test_a_first_occurrence_can_stay(spark):
    rows = [(i, f"same\nown {i}\nsame") for i in range(40)] + [(99, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    drops = Counter(r.doc for r in line_dedup.dropped_lines(df, 2, "first").collect())
    assert sum(drops.values()) == 2 * 40 + 1 - 1
    drops = line_dedup.dropped_lines(df, 2, "none").count()
    assert drops == 2 * 40 + 1


def test_a_line_of_a_third_of_all_rows_is_spread(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"l{i}") for i in range(3000)], "doc_id long, text string").repartition(6)
        assert line_dedup.dropped_lines(df, 10).count() == 1000
        assert line_dedup.dropped_lines(df, 1001).count() == 0
        assert line_dedup.dropped_lines(df, 1000).count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bitmaps_round_trip():
    for n, pos in ((1, [0]), (9, [0, 8]), (100, list(range(0, 100, 3)))):
        bits = line_dedup.unpack(line_dedup.pack(pos, n), n)
        assert [i for i in range(n) if not bits[i]] == pos


def repeated(ws, w):
    c = Counter(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1))
    return len({j for i in range(len(ws) - w + 1) if c[tuple(ws[i : i + w])] > 1 for j in range(i, i + w)})


def test_repetition_is_that_of_counted_windows():
    rng = random.Random(1)
    docs = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))] for _ in range(150)]
    (five, ten), longest = quality.repetition(docs, (5, 10))
    for d, a, b, m in zip(docs, five, ten, longest, strict=True):
        assert (a, b) == (repeated(d, 5), repeated(d, 10))
        assert m == max([k for k in range(5, len(d)) if repeated(d, k)], default=0)


def test_quality_counts(spark, documents, corpus):
    got = quality.judge(documents, carry=("doc_id", "text")).collect()
    assert len(got) == len(corpus)
    for r in got:
        t = r.text or ""
        ws = t.encode().split()
        assert (r.n_words, r.word_chars) == (len(ws), sum(len(w.decode()) for w in ws))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_repeat_words == repeated(ws, 5)
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(ws) < 10 or 100 * repeated(ws, 5) > 20 * len(ws)) and not (r.kept and r.base_failed)


def test_long_repeats_fail():
    rng = random.Random(3)
    own = [f"w{rng.random()}" for _ in range(2000)]
    part = own[:60]
    m = quality.measures([" ".join(own + part), " ".join(own), " ".join(own + part[:40])], quality.Rules())
    assert m["kept"].tolist() == [False, True, True] and m["longest_repeat"].tolist() == [60, 0, 40]


def test_tokens_are_those_of_the_library(spark, documents, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.count_tokens(documents, path, ("doc_id", "text"), 30).collect()
    assert len(got) == len(corpus)
    for r in got:
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 30)


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "́", " ", "\n", "\t", "\x85", "\u00a0", "\u2028", "\x1c", "'s", "'", "1", "23", "<|endoftext|>", "日", "😀", "İ", "Σ", ".", "!!", "\u200b", "\x00", "\r", "\u3000"]
    lengths = token_counts.Lengths(open(path, encoding="utf-8").read(), {})
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert sum(lengths[w] for w in token_counts.split(text)) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(encoder, library):
    rng = random.Random(2)
    odd = ["", " ", "  ", "a", "  a  b ", "▁x", "\n\n\t x", " \n", "a ", ".,", " .", "<s> hi </s><unk>", "naïve 日本語 😀😀 \x00  ", "aaaaaaaaaaaaa" * 5, "    " * 9 + "x", " ▁ ▁", "x" + " " * 37, "\ufffd", "<0x41>", "word " * 3000]
    for letters in ("abcde thn  ▁é😀日\n.,", "ab ,.", "aing ther"):
        odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in odd:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = list(memoryview(encoder.ids(text)).cast("I"))
        assert got == want, repr(text)
        assert encoder.decode(got) == library.decode(want), repr(text)


def test_any_ids_decode_as_the_library_does(encoder, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(32000 if rng.random() < 0.5 else 300) for _ in range(rng.randint(0, 6))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_encoding_tables(spark, documents, corpus, nothing, library):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for r in pieces.encode(documents, path, ("doc_id", "text")).collect():
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == (r.text or "")
    got = pieces.digests(documents, path, ("text",)).collect()
    assert len(got) == len(corpus)
    for r in got:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(nothing, path).count() == 0


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [1, 1, 1], 30) == [10, 10, 10]
    got = mixing.targets([1, 100, 100], [5, 2, 1], 150)
    assert got[0] == 2 and sum(got) == pytest.approx(150) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 0], [1, 1], 0) == [0, 0] and mixing.targets([], [], 5) == []
    assert mixing.targets([1, 1], [1, 1], 100) == [2, 2]


def test_the_mix_meets_its_targets_and_repeats_itself(spark, documents, corpus):
    mix = mixing.Mix(documents, shards=5)
    rows = [tuple(r) for r in mix.taken().collect()]
    assert len(rows) == len(corpus)
    size = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode().split())) for r in corpus)
    assert sorted((d is None, d or 0, n) for d, _, n, _ in rows) == size
    assert all(0 <= t <= 2 * n for _, _, n, t in rows)
    by = defaultdict(int)
    for _, s, _, t in rows:
        by[s] += t
    assert [s.name for s in mix.sources] == ["s0", "s1", "s2", "s3", "s9", None]
    for s in mix.sources:
        assert abs(by[s.name] - s.target) <= 2 * s.block + 1, s
    again = mixing.Mix(documents.repartition(3), shards=5)
    assert sorted(map(repr, rows)) == sorted(map(repr, (tuple(r) for r in again.taken().collect())))


def test_pieces_cover_what_is_taken_and_shards_share_alike(spark, documents):
    mix = mixing.Mix(documents, shards=5)
    got = mix.pieces().collect()
    assert sum(r.n_words for r in got) == sum(r.taken for r in mix.taken().collect())
    per = Counter()
    for r in got:
        per[r.shard] += r.n_words
        assert 0 < r.n_words <= r.size - r.first_word
    assert set(per) == set(range(5)) and max(per.values()) < 1.3 * min(per.values())
    texts = mix.texts().collect()
    assert sum(len(r.text.encode().split()) for r in texts) == sum(r.n_words for r in got) and all(r.n_chars == len(r.text) for r in texts)


def test_tree_and_permutation():
    tree = mixing.Tree([50, 0, 7, 31], 6, 3)
    count = Counter((i, tree.shard(i, p)) for i, q in enumerate([50, 0, 7, 31]) for p in range(q))
    assert sum(count.values()) == 88
    for s in range(6):
        assert sum(count[i, s] for i in range(4)) == 88 * (s + 1) // 6 - 88 * s // 6
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(n, x, 9) for x in range(n)) == list(range(n))
    assert mixing.cut_words(" a  b c ", 3, 1, 1) == "b " and mixing.cut_words(" a  b c ", 3, 0, 2) == " a  b " and mixing.cut_words(" a  b c ", 3, 2, 1) == "c "


def test_empty_tables(spark, nothing):
    assert line_dedup.apply_bitmaps(nothing).count() == 0 and quality.judge(nothing).count() == 0 and quality.accepted(nothing).count() == 0
    assert token_counts.count_tokens(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    mix = mixing.Mix(nothing)
    assert mix.taken().count() == 0 and mix.texts().count() == 0 and list(itertools.chain(mix.sources)) == []
