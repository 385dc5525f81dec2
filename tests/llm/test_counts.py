"""Token counts against the tokenizer, phrases and their filters against plain counting."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyboard.llm import phrases, token_counts

DOCS = "doc_id long, text string, lang string, n_tokens string, counted_text int, scored int"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "\n", " \n", "\t", "a", "the", "▁", " ▁", "é", "中文", "🙂", "</s>", "<s>", "<unk>",
             "<0x0A>", "\r\n", "\xa0", "　", "ing", "Ω", "123", "...", "x" * 50, "\0", "ﬁ", "‍"]
    found = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    found += ["", None, " ", "\n", "  \n  ", "word " * 30_000, "x" * 30_000, " " * 5000, "the\n" * 3000]
    return found


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_counts_are_those_of_the_tokenizer(spark, monkeypatch, model, texts, size):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", size)
    count = token_counts.Counter(model, token_counts.prove(model))
    own = [t or "" for t in texts if len(t or "") < 4000 or size > 7]
    assert count(own) == [len(model.encode(t)) for t in own]
    rows = [(i, t, None, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "the end", None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    into = token_counts.count_tokens(docs, [F.col("doc_id"), F.col("counted_text")], into="tokens")
    found = Counter((r.doc_id, r.tokens) for r in into.collect())
    assert found == Counter((r[0], len(model.encode(r[1] or ""))) for r in rows)
    assert token_counts.count_tokens(docs.where("false"), [F.col("doc_id")]).count() == 0


def test_whole_tokens_are_proved(model, monkeypatch):
    shortcut = token_counts.prove(model)
    assert len(shortcut.whole) > 30_000 and " the" in shortcut.whole and "the" in shortcut.whole
    sample = random.Random(1).sample(sorted(shortcut.whole), 500)
    assert all(len(model.encode("\n" + word)) == 3 for word in sample)
    calls = []

    class Watched:
        def __getattr__(self, name):
            return getattr(model, name)

        def encode(self, words):
            calls.append(words)
            return model.encode(words)

    assert token_counts.Counter(Watched(), shortcut)(["the end of the day", "zzqx the zzqx"]) == [5, len(model.encode("zzqx the zzqx"))]
    assert sorted(w for words in calls for w in words) == ["\n zzqx"]

    class Joined(Watched):
        def id_to_piece(self, number):
            return "a▁b" if number == 500 else model.id_to_piece(number)

    with pytest.raises(ValueError, match="after a cut"):
        token_counts.prove(Joined())


@pytest.mark.parametrize("n, bits, segment_bits", [(2, 5, 2), (2, 17, 9), (3, 17, 6), (3, 21, 12), (3, 28, 4), (2, 3, 10)])
def test_filters_lose_nothing(n, bits, segment_bits):
    rng = np.random.default_rng(bits)
    packing = phrases.Packing(n, bits, segment_bits)
    words = [np.minimum(rng.zipf(1.5, 20_000), (1 << bits) - 1).astype(np.uint64) for _ in range(n)]
    words = [np.append(w, rng.integers(1, 1 << bits, 5000).astype(np.uint64)) for w in words]
    left, right = packing.permuted(words)
    assert all((a == b).all() for a, b in zip(packing.restored(left, right), words, strict=True))
    segment, high, low = packing.cut(left, right)
    expected, found = Counter(zip(*(w.tolist() for w in words), strict=True)), Counter()
    for s in np.unique(segment):
        at = segment == s
        first = np.flatnonzero(at)[::2]
        second = np.flatnonzero(at)[1::2]
        lists = []
        for part in (first, second):
            if len(part):
                sums = phrases.summed(high[part], low[part], np.ones(len(part), np.int64))
                data = phrases.as_filter(*sums, packing.width)
                back = phrases.from_filter(data)
                assert all((a == b).all() for a, b in zip(back, sums, strict=True))
                lists.append(back)
        high_, low_, counts = phrases.summed(*(np.concatenate(x) for x in zip(*lists, strict=True)))
        ids = packing.restored(*packing.joined(int(s), high_, low_))
        found.update(dict(zip(zip(*(w.tolist() for w in ids), strict=True), counts.tolist(), strict=True)))
    assert found == expected


def test_filters_are_compact():
    packing = phrases.Packing(3, 17, 6)
    rng = np.random.default_rng(2)
    words = [rng.integers(1, 1 << 17, 1 << 18).astype(np.uint64) for _ in range(3)]
    segment, high, low = packing.cut(*packing.permuted(words))
    one = segment == 5
    sums = phrases.summed(high[one], low[one], np.ones(int(one.sum()), np.int64))
    assert len(phrases.as_filter(*sums, packing.width)) < 7 * len(sums[0])


def plain_phrases(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0a\x0b\x0c\x0d":
            text = text.replace(c, "\n")
        for part in text.split("\n"):
            words = [w for w in part.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + n])] += 1
    out = []
    for lang, own in counts.items():
        kept = []
        for phrase, a in own.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = []
            for k in range(1, len(phrase)):
                left, right = own[phrase[:k]], own[phrase[k:]]
                cuts.append((int(Fraction(10**6 * a * a, left * right)), k, left, right))
            score, _, left, right = min(cuts)
            longer = [f for p, f in own.items() if f >= least and len(p) == 3 and len(phrase) == 2
                      and phrase in (p[:2], p[1:])]
            if not any(100 * f >= 50 * a for f in longer):
                kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, held", [(4, 3_000_000), (2, 50)])
def test_phrases(spark, monkeypatch, least, held):
    rng = random.Random(9)
    words = ["the", "The", "of", "New", "york", "city", "a\x01", "a", "é", "E", "z" * 40, *(f"w{i}" for i in range(30))]
    seps = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", " ? ", "-", "\xa0"]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice(seps[:2] if rng.random() < 0.8 else seps)
                       for _ in range(rng.randint(0, 60)))
        rows.append((text + "new york city " * rng.randint(0, 2), rng.choice(["en", "de", None, "und"])))
    rows += [("", "en"), (None, None), ("...", "fr"), ("one", "it"), rows[0], rows[0], ("b c " * 40_000, "long"),
             ("b c. " * 3000, "long")]
    monkeypatch.setattr(phrases, "PIECE_BYTES", 3000)
    monkeypatch.setattr(phrases, "HELD_GRAMS", held)
    monkeypatch.setattr(phrases, "SEGMENT_GRAMS", 1000)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, f int, word int")
    found = phrases.collocations(docs, least, top=25)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, least, 25)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**12
    words = spark.createDataFrame([("en", 1, "a", 2 * big), ("en", 2, "b", 3 * big)], "lang string, id long, word string, f long")
    grams = spark.createDataFrame([("en", [1, 2], big)], "lang string, ids array<long>, f long")
    row = phrases.scored(phrases.Counts(words, grams, words)).first()
    assert (row.score, row.l, row.r) == (10**6 // 6, 2 * big, 3 * big)
