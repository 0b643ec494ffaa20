import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm import shingles as S
from folioworks.llm.automaton import SuffixAutomaton
from folioworks.llm.tagger import Tagger

BLANK, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, rx=BLANK):
    w = re.findall(rx, lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Cc.\t\né \U0001f600", max_size=60)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_sets_are_those_of_plain_python(texts):
    for rx, table in ((BLANK, S.BLANK_WORDS), (PLAIN, S.PLAIN_WORDS)):
        seen = {}
        for (i, members), text in zip(S.shingle_sets(pa.array(texts, pa.string()), table), texts, strict=True):
            assert texts[i] == text
            want = shingles(text, rx)
            assert len(members) == len(want)
            seen[frozenset(want)] = seen.get(frozenset(want), members)
            assert np.array_equal(seen[frozenset(want)], members)


def test_long_texts_and_runs():
    texts = ["x y z " * 50_000, "", "one", "a b c d e f"] * 3
    column = pa.chunked_array([pa.array(texts[:5]), pa.array(texts[5:])])
    assert [len(m) for _, m in S.shingle_sets(column, S.BLANK_WORDS)] == [len(shingles(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=15), min_size=1, max_size=4), st.text(alphabet="abcd", max_size=25))
def test_matching_statistics(samples, text):
    automaton = SuffixAutomaton()
    for s in samples:
        automaton.add(map(ord, s))
    for end, length in enumerate(automaton.matching(list(map(ord, text)))):
        want = max(k for k in range(end + 2) if any(text[end + 1 - k : end + 1] in s for s in samples))
        assert length == want


def test_tagger_gradients():
    r = np.random.default_rng(0)
    tagger = Tagger(3, embed=4, hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, gold = r.integers(0, 99, (6, 2)), r.integers(0, 3, (6, 2))
    _, grads = tagger.loss(ids, gold)
    for name in ("T", "S", "Wo", "Whf", "Wxb", "bb", "E"):
        place = tuple(r.integers(0, n) for n in tagger.p[name].shape) if name != "E" else (ids[2, 1], 1)
        eps = 1e-3
        tagger.p[name][place] += eps
        up = tagger.loss(ids, gold)[0]
        tagger.p[name][place] -= 2 * eps
        down = tagger.loss(ids, gold)[0]
        tagger.p[name][place] += eps
        assert abs((up - down) / (2 * eps) - grads[name][place]) < 5e-3, name
