"""Operators on single texts, against plain versions and labelled fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import language, licenses, pii, toxicity, urls
from folioworks.llm.queries import QUERIES

from .test_shingles import PLAIN, lower

DOCS = "doc_id long, text string"
# words by syllables, other ones for each language
SYLLABLES = {"aa": ["th", "on", "er", "an", "re"], "bb": ["sch", "ung", "ein", "ver", "ich"], "cc": ["eau", "ré", "eux", "ou", "ê"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1 if doc_id is not None else False


def test_language_held_out_accuracy(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, lang, r.randint(4, 400)), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(150))]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 ... !", None), (None, rows[0][1], None), (903, rows[0][1], None), (903, rows[0][1], None), (904, "thoneran " * 60_000, "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.language_of(docs).collect()}
    known = {i: lang for i, _, lang in rows}
    assert all(got[i].lang_pred == lang for i, lang in known.items())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert got[None].lang_pred == got[903].lang_pred == rows[0][2] and got[904].lang_pred == "aa"
    assert {x.lang_pred for x in language.language_of(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}
    assert language.language_of(docs.limit(0)).collect() == []
    kept = language.keep_identified(docs.withColumn("score", docs.doc_id))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(rows) + 4


def test_language_samples_spread_over_distinct_texts(spark):
    r = random.Random(12)
    texts = [sentence(r, "aa", 300) for _ in range(100)]
    rows = [(t, "aa") for t in texts for _ in range(80)] + [("short " + str(i), "bb") for i in range(500)] + [(sentence(r, "cc", 2000), "cc")] * 3
    got = language.samples_of(spark.createDataFrame(rows, "text string, lang string").repartition(5), 6400)
    assert len(set(got["aa"])) == len(got["aa"]) == 64 and all(any(x in t for t in texts) for x in got["aa"])
    assert not all(any(t.startswith(x) for t in texts) for x in got["aa"])
    assert len(set(got["bb"])) == 500 and sum(map(len, got["aa"])) == sum(map(len, got["cc"])) == 6400 and len(got["cc"]) == 1


def test_junk_and_foreign_text_is_not_identified(spark):
    r = random.Random(6)
    rows = [(i, sentence(r, lang, r.randint(4, 400)), lang) for i, lang in enumerate(r.choice(["aa", "bb"]) for _ in range(150))]
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1000))
    docs = spark.createDataFrame([*rows, (1, letters, None), (4, letters[:150], "aa"), (7, sentence(r, "cc", 80), None), (10, sentence(r, "aa", 3000), "bb")], "doc_id long, text string, lang string")
    kept = language.keep_identified(docs).collect()
    texts = {x.text for x in kept}
    assert {t for _, t, _ in rows} <= texts
    assert letters not in texts and letters[:150] not in texts
    assert len(kept) == len(rows) + 1  # the foreign one is gone, the long one stays


def test_null_languages_are_filled(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, lang, r.randint(40, 400)), lang if i % 5 else None, i) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1], None, 1), (None, rows[0][1], None, 1)], "doc_id long, text string, lang string, lang_pred long")
    got = language.keep_identified(docs).collect()
    assert sorted((x.doc_id, x.lang) for x in got if x.doc_id is not None) == sorted((i, ["aa", "bb"][i % 2]) for i, *_ in rows)
    assert [x.lang for x in got if x.doc_id is None] == ["aa", "aa"]
    nothing = language.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(rows) + 2 and {x.lang for x in nothing} == {None}


def test_languages_of_any_script(spark):
    """Two Cyrillic and two Latin languages beyond Latin-1; emoji, digits and astral letters; a thousand copies of one text."""
    r = random.Random(14)
    made = {"ru": ["ст", "ый", "ов", "при", "ть"], "uk": ["сть", "ій", "ів", "при", "ти"], "pl": ["sz", "ł", "ść", "nie", "ą"], "cs": ["ř", "ně", "ů", "né", "š"]}
    text = lambda lang, n: " ".join("".join(r.choice(made[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, r.randint(8, 300)), lang) for i, lang in enumerate(r.choice(list(made)) for _ in range(300))]
    copies = [(10_000 + i, "ст ст ст", "ru") for i in range(1000)]
    odd = [(900, "\U0001f600\U0001f680", None), (901, "1234 !", None), (902, "\U00010400\U00010401", None), (903, "\u0301\u0302", None), (904, text("uk", 100_000), None)]
    got = {x.doc_id: x.lang_pred for x in language.language_of(spark.createDataFrame([*rows, *copies, *odd], "doc_id long, text string, lang string").withColumn("score", F.lit(1))).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)
    assert [got[i] for i in (900, 901, 903)] == ["und"] * 3 and got[902] != "und" and got[904] == "uk"


def test_tiny_samples_win_nothing(spark):
    r = random.Random(23)
    rows = [(i, sentence(r, lang, 120), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(900 + i, t, "xx") for i, t in enumerate(["th on", "123", "e", "!"] * 3)]
    got = {x.doc_id: x.lang_pred for x in language.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows if i < 900)


def test_sorted_steps_parse_like_dense_ones():
    r = random.Random(13)
    samples = {k: [sentence(r, k, 60), sentence(r, k, 5)] for k in SYLLABLES}
    dense, listed = language.Model(samples), language.Model(samples, dense=0)
    texts = [sentence(r, r.choice(list(SYLLABLES)), 80) + "Ж" for _ in range(20)] + ["", "ЖЖ", "x" * 2000]
    assert (dense.costs(texts)[0] == listed.costs(texts)[0]).all() and dense.costs(texts)[0].any()


@pytest.mark.parametrize("dense", [0, language.DENSE])
def test_cross_parse_is_greedy(dense):
    r = random.Random(5)
    samples = {"x": ["".join(r.choice("abc") for _ in range(40))], "y": ["".join(r.choice("bcd") for _ in range(40))]}
    model = language.Model(samples, dense)
    for _ in range(30):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 60)))
        got, _ = model.costs([text])
        for k, name in enumerate(("x", "y")):
            phrases, at = 0, 0
            while at < len(text):
                size = max((n for n in range(1, len(text) - at + 1) if text[at : at + n] in samples[name][0]), default=1)
                phrases, at = phrases + 1, at + size
            assert got[0][k] == pytest.approx(phrases * model.scale[k])


def plain_license(text):
    words = re.findall(PLAIN, lower(text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def test_license_base_and_templates(spark):
    r = random.Random(3)
    bits = ["cc", "by", "CC-BY", "general public license", "All rights reserved.", "é", "x", "by cc by", "all rights"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(100, None), (None, "cc by")]
    more = {200: "Foo bar. Released under the MIT License. Baz", 201: "mit license software is nice", 202: "x " * 5000 + "Licensed under the Apache License, Version 2.0.", 203: "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files, to deal in the Software without restriction"}
    docs = spark.createDataFrame(rows + list(more.items()), DOCS)
    got = {x.doc_id: x for x in licenses.scan_licenses(docs).collect()}
    for i, text in rows:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == plain_license(text)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
    assert got[200].labels == "mit" and [(s.first, s.last) for s in got[200].spans if s.cover == 1] == [(2, 6)]
    assert got[201].labels == "" and got[201].score == 0
    assert got[202].labels == "apache-2.0" and got[202].spans[0].first == 5000
    assert got[203].labels == "mit" and 0.75 <= got[203].score < 1
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_license_odd_rows(spark):
    """Clashing columns, repeated rows and very long texts."""
    rows = [(1, "cc by " * 200_000, "a"), (2, "licensed under the mit " * 50_000, "b"), (3, "cc by", "c"), (3, "cc by", "c"), (3, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").withColumn("spans", F.lit(1))
    got = sorted(((x.doc_id, x.n_words, x.n_base, x.last_word, x.labels, x.score) for x in licenses.scan_licenses(docs).collect()), key=str)
    assert got[0][:5] == (1, 400_000, 200_000, 399_998, "cc-by") and got[0][5] == 0.5
    assert got[1][:4] == (2, 200_000, 0, None) and got[1][5] > 0.5
    assert got[2:] == [(3, 0, 0, None, "", 0.0), (3, 2, 1, 0, "cc-by", 0.5), (3, 2, 1, 0, "cc-by", 0.5)]


def test_chains_are_the_best_ones():
    """Against all chains of few matches."""
    r = random.Random(15)
    scanner = licenses.Scanner()

    def best(matches):
        def go(chain, covered):
            top = covered
            for at, place, size in matches:
                if chain is None:
                    top = max(top, go((at, place, size), size))
                    continue
                a, p, n = chain
                ahead = max(a + n - at, p + n - place, 0)
                if a < at and p < place and size > ahead and at + ahead - a - n <= licenses.MAX_GAP and place + ahead - p - n <= licenses.MAX_GAP:
                    top = max(top, go((at, place, size), covered + size - ahead))
            return top

        return go(None, 0)

    for _ in range(300):
        matches = list({(r.randrange(30), r.randrange(20), r.randint(4, 9)) for _ in range(r.randint(1, 7))})
        chains = scanner._chains(matches)
        assert max(c for c, _, _ in chains) == best(matches)


def test_license_template_recall():
    """Templates pasted into other words, with a word in twelve changed, left out or put in: nine in ten and more are labelled."""
    r = random.Random(16)
    scanner, found, n = licenses.Scanner(), 0, 0
    for _ in range(20):
        for label, text in licenses.TEMPLATES:
            words = text.split()
            for _ in range(len(words) // 12):
                at = r.randrange(1, len(words))
                words[at : at + r.choice((0, 1, 1))] = r.choice(([], ["other"], ["one"]))
            got = scanner.scan(sentence(r, "aa", 40) + " " + " ".join(words).title() + ". " + sentence(r, "bb", 40))
            found, n = found + (label in got["labels"].split(",")), n + 1
    assert found >= 0.9 * n


def plain_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = lower(host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else ("block" if host == "" else "allow")


@pytest.mark.parametrize("block", [2, 1000])
def test_urls_are_brute_force(spark, block):
    r = random.Random(8)
    labels = ["org", "com", "example", "a", "b", "orgx"]
    rules = list({(h, p): v for h, p, v in ((".".join(r.choice(labels) for _ in range(r.randint(1, 3))), r.choice(["/", "/e", "/en/", "/en/1", ""]), r.choice(["allow", "block"])) for _ in range(40))}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, r.choice(["http", "HTTPS", ""]) + r.choice(["://", "://", "://", ":/"]) + ".".join(r.choice([*labels, "ORG", "Example"]) for _ in range(r.randint(0, 4))) + r.choice(["", "/", "/en/12?x#y", "/en/", "?q=/en/", "#/", "/e/f"])) for i in range(400)]
    pages += [(500, None), (501, ""), (None, "http://a.org/"), (502, "x://y://org/"), (502, "x://y://org/")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.judge_urls(frame, spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("b", "/", "odd")], "host string, path string, verdict string"), block_rules=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain_url(u, rules)) for i, u in pages), key=str)
    none = urls.judge_urls(frame.limit(0), spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.collect() == []


def test_urls_odd_rows(spark):
    """Very long urls, repeated rows, and columns named like the operator's own."""
    rules = [("org", "/", "allow"), ("a.org", "/" + "x" * 5000, "block")]
    pages = [(1, "http://" + "b." * 20_000 + "org/" + "y" * 100_000), (2, "http://c.a.org/" + "x" * 6000 + "?q"), (2, "http://c.a.org/" + "x" * 6000 + "?q"), (3, "://" + "/" * 50_000), (4, "://" * 30_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("key", F.lit(1)).withColumn("rule", F.lit(None).cast("int"))
    got = urls.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain_url(u, rules)) for i, u in pages), key=str)


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_patterns_are_those_of_regular_expressions():
    r = random.Random(1)
    bits = ["a@b.c", "x.y%z", "@", "@h.org", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (736) 555-2678", "+49", "é\U0001f600", "12", "-", " ", ".", "..", "4877619717551252", "0" * 20]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_personal_data(spark):
    r = random.Random(4)
    plain = {i: f"{sentence(r, 'aa', 30)} {w} {sentence(r, 'bb', 30)}" for i, w in enumerate(["bob.12@mail1.example.com", "12.34.56.78", "4877619717551252", "+1 (736) 555-2678", "word", "1998", "v1.2"])}
    other = {50: "reach jim [at] corp [dot] org now", 51: "server 10[.]0[.]0[.]1 is down", 52: "call 555-123-4567 today"}
    rows = [*plain.items(), *other.items(), (80, None), (81, ""), (None, "a@b.c"), (82, "9" * 20_000 + " x" * 100_000 + " a@b.cd"), (83, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    docs = spark.createDataFrame(rows, DOCS)
    tagger = pii.train([sentence(r, k, 60) for k in SYLLABLES for _ in range(5)])
    docs = docs.withColumn("spans", F.lit("x")).withColumn("n_ip", F.lit(9))
    got = {x.doc_id: x for x in pii.find_personal_data(docs, tagger).collect()}
    for i, text in rows:
        base = plain_pii(text or "")
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
    assert [got[i].spans for i in (4, 5, 6, 80, 81)] == [""] * 5
    assert got[83].secrets == "9:49" and got[83].n_found == 1 and got[0].n_found == 1 and got[80].n_found == 0
    assert sum(got[i].spans != "" for i in other) >= 2
    assert pii.find_personal_data(docs.limit(0), tagger).collect() == []


def test_every_valid_span_is_in_a_stretch():
    r = random.Random(8)
    kinds = ["jane.doe at example.com", "jane_at_example.com", "jane AT example dot com", "christopher.alexanderson at engineering-department dot com", "a [at] b.c", "10(.)0(.)0(.)1", "x" * 60 + "@" + "y" * 15 + ".com"]
    for _ in range(200):
        found = r.choice(kinds)
        text = "word, " * r.randint(0, 60) + found + " word" * r.randint(0, 60)
        at = text.index(found)
        assert any(pii._valid(kind, text, at, at + len(found)) for kind in (0, 1))
        assert any(a <= max(0, at - pii.WINDOW // 2) and min(len(text), at + len(found) + pii.WINDOW // 2) <= b for a, b in pii.stretches(text)), text
    assert not pii._valid(0, "a chat.room", 4, 11)


def test_spelled_out_addresses_are_read():
    r = random.Random(4)
    reader = pii.Reader(pii.train([sentence(r, k, 60) for k in SYLLABLES for _ in range(5)]))
    for found in ("jane.doe at example.com", "jane_at_example.com", "jane AT example.com"):
        text = f"{sentence(r, 'aa', 30)} write to {found} {sentence(r, 'bb', 30)}"
        at = text.index(found)
        assert any(kind == 0 and a <= at and at + len(found) <= b for a, kind, b in reader.spans([text])[0]), (found, reader.spans([text]))


def test_tagger_finds_forms_that_it_has_not_seen():
    """Recall with exact ends, per kind, of templates that no example is written in; and what it adds to plain text."""
    r = random.Random(31)
    contexts = [sentence(r, k, 80) + ". " + sentence(r, k, 30) for k in SYLLABLES for _ in range(5)]
    reader = pii.Reader(pii.train(contexts))
    found, n = [0] * 5, 120
    for kind in range(5):
        for _ in range(n):
            _, before, span = pii._entity(r, 1, kind)
            left = r.choice(contexts)[: r.randint(20, 120)].rstrip() + " " + before
            text = left + span + r.choice([" ", ", ", "\n", ") "]) + r.choice(contexts)[:80]
            base = pii.base_spans(text)
            got = base + pii._apart(base, reader.spans([text])[0])
            found[kind] += (len(left), kind, len(left) + len(span)) in got
    assert all(x >= 0.8 * n for x in found) and sum(found) >= 0.9 * 5 * n, found
    plain = [sentence(r, r.choice(list(SYLLABLES)), 200) + f" at home. In {r.randint(1900, 2020)} the dot at {r.randint(1, 99)}." for _ in range(100)]
    assert sum(map(len, reader.spans(plain))) <= 2
    for text, kind, span in (("reach jim [at] corp [dot] org now", 0, "jim [at] corp [dot] org"), ("call (030) 123-4567 now", 3, "(030) 123-4567"), ("to ann at mail dot example dot com today", 0, "ann at mail dot example dot com"), ("pay 4111.1111.1111.1111 now", 2, "4111.1111.1111.1111"), ("please write to bob at example.com please", 0, "bob at example.com")):
        assert (text.index(span), kind, text.index(span) + len(span)) in reader.spans([text])[0], text


def test_toxicity(spark):
    r = random.Random(9)
    bad = ["idiot", "moron", "pathetic", "trash"]
    hide = lambda w: r.choice([w, w.replace("i", "1").replace("o", "0"), " ".join(w), w[:2] + w[2] * 4 + w[3:]])
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(r, r.choice(["aa", "bb"]), r.randint(8, 60)).split()
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
            words.insert(r.randrange(len(words)), hide(r.choice(bad)) if held(i) else r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    odd = [(900, None), (901, ""), (None, "you idiot trash moron"), (902, "1d10t m0r0n you p a t h e t i c one")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    known = spark.createDataFrame([*labels, (5000, 1), (None, 1), (900, None), (4, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, known).collect()}
    test = [i for i, _ in labels if held(i)]
    assert all(got[i].held_out == held(i) for i, _ in labels)
    right = sum(got[i].predicted == y for i, y in labels if held(i))
    assert right / len(test) > 0.95
    assert got[900].score == got[901].score < 0.5 and got[None].predicted == 1 and got[902].predicted == 1
    nothing = toxicity.score_toxicity(docs, known.where("toxic = 7")).collect()
    assert {x.score for x in nothing} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), known).collect() == []


def model_of(text):
    s = np.concatenate(([0, 0], toxicity.symbols_of(text), [0])).astype(int)
    counts = np.bincount((s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], minlength=toxicity.SYMBOLS**3)
    return toxicity.CharacterModel(counts)


def test_viterbi_is_the_best_of_all_readings():
    """Against every path through the lattice of short stretches."""
    r = random.Random(18)
    model = model_of(" ".join(["the idiot loser said a trash talk at it", "list of total tools"] * 20))
    cost, code = model.cost, toxicity._code

    def paths(parts, place, a, b, price, word):
        if place == len(parts):
            yield price + (float(cost[a, b, 0]) if b else 0.0), word
            return
        c = parts[place]

        def blank(price, sign):
            if b == 0:
                return paths(parts, place + 1, a, b, price, word + (sign if sign != " " else ""))
            return paths(parts, place + 1, b, 0, price + float(cost[a, b, 0]), word + sign)

        if c[0] in " ._*-":
            yield from paths(parts, place + 1, a, b, price + (toxicity.SEPARATE_RUN if len(c) > 1 else toxicity.SEPARATE), word)
            yield from blank(price + (toxicity.KEEP_RUN if len(c) > 1 else toxicity.KEEP_BLANK), " ")
            return
        if c in toxicity.LEET:
            yield from blank(price + toxicity.KEEP_SIGN, c)
        three = any(parts[i : i + 3] == [c] * 3 for i in range(max(0, place - 2), place + 1))
        for x, more in [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET[c]] if c in toxicity.LEET else [(c, 0.0)]:
            k = code(x)
            if b == k:
                yield from paths(parts, place + 1, a, b, price + more + (toxicity.REPEAT if three else toxicity.REPEAT_ONCE), word)
            yield from paths(parts, place + 1, b, k, price + more + float(cost[a, b, k]) + toxicity.KEEP_REPEAT * (a == b == k), word + x)

    for _ in range(150):
        seen = "".join(r.choice(["i", "1", "t", "0", " ", "  ", "l", "a", "o", "5", "tt", "."]) for _ in range(r.randint(1, 8)))
        every = dict((w, p) for p, w in sorted(paths(re.findall(r"[ ._*-]+|.", seen), 0, 0, 0, 0.0, ""), reverse=True))
        got = model.restore(seen)
        assert got in every and every[got] == pytest.approx(min(every.values()), abs=1e-4), seen


def test_restored_stretches_of_any_length():
    restore = toxicity.Restorer(model_of(" ".join(["you are the idiot and a loser here it is trash now"] * 50)))
    assert restore("i" + 100 * "d" + "iot") == "idiot"
    assert restore("a i d i o t") == "a idiot" and restore("i d i o t 2 times") in ("idiot2 times", "idiot 2 times")
    assert restore("t  r  a  s  h") == "trash" and restore("a.r.e") == "are" and restore("i_d_1_0_t") == "idiot"
    spaced = " ".join("trash" * 12)
    assert restore(spaced).replace(" ", "") == "trash" * 12
    assert restore("1 2 3 4 5 6") == "1 2 3 4 5 6" and restore.restored == 0
    assert len(restore("1d10t" * 40_000)) <= 200_000


def test_toxicity_in_other_scripts(spark):
    r = random.Random(19)
    word = lambda: "".join(r.choice("абвгдежзиклмнопрст") for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join([*(word() for _ in range(r.randint(5, 40))), *(["дурачина"] if i % 3 == 0 else [])])) for i in range(300)]
    rows += [(900, "д у р а ч и н а " + word()), (901, word() + " дурааааачина"), (902, "\U0001f600 " * 50_000), (902, "x" * 300_000 + "1" * 300_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x"))
    got = toxicity.score_toxicity(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")).collect()
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in got if x.doc_id < 300)
    assert {x.predicted for x in got if x.doc_id in (900, 901)} == {1} and {x.predicted for x in got if x.doc_id == 902} == {0}
    assert len(got) == len(rows)


def test_restored_words():
    text = " ".join(["the idiot loser is pathetic and disgusting trash"] * 50)
    restore = toxicity.Restorer(model_of(text))
    assert restore("1d10t l0ser p a t h e t i c d1sgust1ng t.r.a.s.h idiiiiot") == "idiot loser pathetic disgusting trash idiot"
    assert restore("the plain book of 12 words, v2") == "the plain book of 12 words, v2"


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{k}" for k in range(1, 11)]


def test_batches_are_taken_in_slices_of_few_bytes():
    import pyarrow as pa

    from folioworks.llm import language

    texts = ["x" * n for n in (5, language._BYTES, 3, 2 * language._BYTES, 1)] + [None, "é"] + ["z"] * (language._ROWS + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(language._parts(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= language._BYTES for p in parts) and max(p.num_rows for p in parts) <= language._ROWS
    assert list(language._parts(batch.slice(0, 0), 1)) == []
