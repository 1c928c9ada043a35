import math
from collections import Counter

import pytest

from gazette.llm import lm

SCHEMA = "doc_id bigint, text string"


def brute(docs, target, background=None, weight=0.7):
    """Losses from all counts; words that neither side has are unknown."""
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    sides = [[lower(t) for t in side] for side in (target, [t for _, t in docs] if background is None else background)]
    single = [Counter(w for d in s for w in d) for s in sides]
    pairs = [Counter(p for d in s for p in zip(["^", *d], d)) for s in sides]
    firsts = [Counter(a for d in s for a in ["^", *d][:len(d)]) for s in sides]
    size, out = len(set(single[0]) | set(single[1])) + 1, []
    for key, text in docs:
        d = lower(text)
        loss = [-sum(math.log(weight * p[a, b] / max(f[a], 1) + (1 - weight) * (s[b] + 1) / (s.total() + size)) for a, b in zip(["^", *d], d))
                for s, p, f in zip(single, pairs, firsts)]
        out.append((key, len(d), *(x / max(len(d), 1) for x in loss)))
    return sorted(out, key=repr)


def same(made, wanted):
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in made.collect()), key=lambda r: (repr(r[:2]), r[2:]))
    for a, b in zip(got, sorted(wanted, key=lambda r: (repr(r[:2]), r[2:])), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-8)


@pytest.mark.parametrize("chunk, segment", [(4 << 20, 1 << 22), (64, 1 << 22), (64, 16)])
def test_losses_are_those_of_the_models(frame, monkeypatch, chunk, segment):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    docs = [(i, f"the cat {i % 3} sat on the MAT {'x' * (i % 5)} and the dog ran") for i in range(20)] + [
        (20, None), (21, ""), (22, "unseen words only here"), (None, "the cat"), (0, "the dog"), (23, "\u00e9 \u00c9\tthe\nthe " * 200)]
    target = ["the cat sat on the mat", "the cat ran and sat", None, "", "the zebra"]
    same(lm.scores(frame(docs, SCHEMA), frame([(t,) for t in target], "text string")), brute(docs, target))


def test_documents_like_the_target_score_lower(frame):
    docs = [(i, "red green blue " * 9 if i < 5 else "one two three " * 9) for i in range(30)]
    made = {r.doc_id: r.difference for r in lm.scores(frame(docs, SCHEMA), frame([("red green blue red green",)], "text string")).collect()}
    assert max(made[i] for i in range(5)) < min(made[i] for i in range(5, 30))


def test_empty_tables_and_other_columns(frame):
    none = frame([], "text string")
    assert lm.scores(frame([], SCHEMA), none).count() == 0
    made = lm.scores(frame([(1, "a b", 3, 4)], SCHEMA + ", n int, k int"), none).first()
    assert made.doc_id == 1 and made.n_tokens == 2 and made.target_loss > 0


@pytest.mark.parametrize("apart", [False, True])
def test_models_keep_rare_words_and_bigrams(frame, apart):
    # Beside 140,000 equal words each other word is a very small share of the tokens.
    docs = [(0, "the " * 140_000), *[(i, f"rare{i} the rare{i % 3} odd") for i in range(1, 20)], (20, None), (21, ""), (None, "the rare5"),
            (5, "again"), (6, "again"), (6, "again")]
    target = ["rare1 the rare2", None, "zebra the"]
    known = [t for _, t in docs[:9]] if apart else None
    made = lm.scores(frame(docs, SCHEMA), frame([(t,) for t in target], "text string"), frame([(t,) for t in known], "text string") if apart else None)
    same(made, brute(docs, target, known))


@pytest.mark.parametrize("chunk, more", [(4 << 20, False), (64, False), (64, True)])
def test_chosen_documents_are_the_target(frame, monkeypatch, chunk, more):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    docs = [(i, f"odd{i % 3} words the {i % 7} of") for i in range(40)] + [(None, "of no key"), (3, "twice the three"), (5, None), (6, "")]
    extra = ["beside the documents"] if more else []
    made = lm.scores(frame(docs, SCHEMA), frame([(t,) for t in extra], "text string") if more else None,
                     chosen=frame([(3,), (3,), (5,), (11,), (99,), (None,)], "doc_id bigint"))
    same(made, brute(docs, extra + [t for k, t in docs if k in (3, 5, 11)]))


def test_counts_beyond_a_byte_and_beyond_two(frame, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1 << 10)
    docs = [(i, "a b " * 300 + f"w{i}") for i in range(130)]
    target = ["a b " * 100, "b a"]
    same(lm.scores(frame(docs, SCHEMA), frame([(t,) for t in target], "text string")), brute(docs, target))


def test_models_of_few_texts(frame):
    made = lm.scores(frame([(1, "a b", 3, 4)], SCHEMA + ", n int, k int"), frame([], "text string")).first()
    assert made.doc_id == 1 and made.n_tokens == 2 and made.target_loss == pytest.approx(math.log(3) - math.log(0.3))
