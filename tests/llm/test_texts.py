import itertools
import random

import numpy as np
import pytest

from sightweave.llm import leaks, residue

VOCAB = [f"w{i}" for i in range(4000)]


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item long, passage string")
    return {tuple(r) for r in leaks.leaked_items(d, "doc_id", "text", i, "item", "passage", **kw).collect()}


def test_every_pattern_of_one_change_in_ten_hits_a_seed():
    for n in range(10, 20):
        for bad in range(n):
            ok = np.ones(n, bool)
            ok[bad] = False
            assert any(all(ok[s + i] for i in range(len(m)) if m[i] == "1") for m in leaks.MASKS for s in range(n - len(m) + 1))
    for bad in itertools.combinations(range(20), 2):
        ok = np.ones(20, bool)
        ok[list(bad)] = False
        assert any(all(ok[s + i] for i in range(len(m)) if m[i] == "1") for m in leaks.MASKS for s in range(20 - len(m) + 1))


@pytest.mark.parametrize("most_bits", [leaks.MOST_BITS, 15])
def test_leaks_and_what_is_none(spark, monkeypatch, most_bits):
    """Also with a filter that lets nearly every window pass."""
    monkeypatch.setattr(leaks, "LEAST_BITS", 15)
    monkeypatch.setattr(leaks, "MOST_BITS", most_bits)
    rng = random.Random(6)
    p = {i: passage(rng, n) for i, n in enumerate([60, 40, 14, 10, 4, 100])}
    items = [(i, " ".join(w).capitalize() + ".") for i, w in p.items()] + [(90, None), (91, "  "), (None, "w1 w2 w3 w4 w5 w6 w7")]
    pad = lambda: " ".join(passage(rng, 30))
    changed = [("x%d" % k if k % 11 == 5 else w) for k, w in enumerate(p[0])]
    shuffled = p[1][:]
    rng.shuffle(shuffled)
    docs = [
        (1, f"{pad()} {' '.join(p[0])} {pad()}"),
        (2, " ".join(changed).upper()),
        (3, "\n".join("> " + " ".join(p[1][i : i + 6]) for i in range(0, 40, 6))),
        (4, f"{pad()} {' '.join(p[1][7:27])} {pad()}"),  # twenty words of it
        (5, f"{pad()} {' '.join(p[1][7:26])} {pad()}"),  # nineteen: no case
        (6, " ".join(shuffled)),
        (7, "<p>" + "</p><p>".join(f"<i>{w}</i>" for w in p[2]) + "</p>"),
        (8, " ".join(w[:1] + "​­" + w[1:] for w in p[3])),
        (9, " ".join(p[3][:9])),
        (10, " ".join(["zz" if k == 4 else w for k, w in enumerate(p[3])])),
        (11, f"{pad()} {' '.join(p[4])} {pad()}"),
        (12, " ".join(["zz" if k == 2 else w for k, w in enumerate(p[4])])),
        (13, " ".join("y" if k % 5 == 0 else w for k, w in enumerate(p[5]))),  # too many changes
        (14, None),
        (15, ""),
        (16, " ".join(p[0]) + " " + " ".join(passage(rng, 60_000)) + " " + " ".join(p[1])),
        (1, " ".join(p[0])),
        (17, " ".join(p[1][:20]) + ' <img alt="' + "x " * 400 + '"> ' + " ".join(p[1][20:])),
    ]
    want = {(1, 0), (2, 0), (3, 1), (4, 1), (7, 2), (8, 3), (10, 3), (11, 4), (16, 0), (16, 1), (17, 1)}
    assert found(spark, docs, items) == want


def test_empty_tables(spark):
    assert found(spark, [(1, "a b c")], [(1, None)]) == set()
    assert leaks.leaked_items(spark.createDataFrame([], "d long, t string"), "d", "t", spark.createDataFrame([(1, "a b c d e f g")], "i long, p string"), "i", "p").count() == 0


def slow(ids, passage, shift):
    lo, hi = max(0, -shift), min(len(passage), len(ids) - shift)
    same = ids[lo + shift : hi + shift] == passage[lo:hi]
    if len(same) == len(passage) and (~same).sum() <= len(same) // 10:
        return True
    return any((~same[a:b]).sum() <= (b - a) // 10 and same[a] and same[b - 1] for a in range(len(same)) for b in range(a + 20, len(same) + 1))


def test_against_plain_comparison():
    rng = random.Random(8)
    hashes = leaks.Hashes()
    items = [(i, passage(rng, rng.randrange(10, 60))) for i in range(40)]
    seen = set()
    for _ in range(400):
        i, w = rng.choice(items)
        a = rng.randrange(len(w))
        piece = w[a : a + rng.randrange(5, 60)]
        for k in range(len(piece)):
            if rng.random() < 0.08:
                piece[k] = "zz"
        doc = [*passage(rng, 15), *piece, *passage(rng, 15)]
        ids, own = hashes.of(" ".join(doc)), hashes.of(" ".join(w))
        want = any(slow(ids, own, s) for s in range(-len(w), len(doc)))
        assert leaks.carried(ids, own) == want
        assert all(leaks.carries(ids, own, s) == slow(ids, own, s) for s in range(-len(w), len(doc)))
        seen.add(want)
    assert seen == {True, False}


TALK = [
    "How do I write a noscript block that says “Please enable JavaScript” only for visitors of Foo? It fails for me.",
    "My engine prints `{{ user_name }}` literally instead of the value. How can I escape it?",
    "Our designer filled the page with lorem ipsum text; which setting removes the filler on deploy? Nobody here knows it.",
    "Crawling returns a page titled 404 Not Found although the page exists. Is that a robots rule?",
    "Curl prints:\n\n```\n404 Not Found\n```",
    "Here is the output:\n\n    502 Bad Gateway\n    host.invalid",
    "<pre><code>{{ title }}</code></pre>",
    "Thanks!", "", None, "   ", "See https://a.invalid/x", "No.",
]
RESIDUE = [
    "Please enable JavaScript to continue using this application.",
    "KINDLY ENABLE JAVASCRIPT TO PROCEED USING THIS APPLICATION.",
    "404 Not Found",
    "Brand - 502 Bad Gateway\nhost.invalid",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.",
    "Hello {{ user_name }}, thank you for asking about %(title)s. Your answer: [INSERT BODY HERE]",
    "test test test test test test",
    "A real answer that tells how to fix it at length.\n\nBitte aktivieren Sie JavaScript, um diese Seite zu sehen.\n\nMore of the answer.",
    "<html><head><title>HTTP Error 503. The service is unavailable.</title></head><body><h1>HTTP Error 503. The service is unavailable.</h1></body></html>",
    "TODO: write this section",
]


def test_residue_is_found_and_talk_about_it_is_not(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("the server session page request handler gateway cache token breaks slowly again whenever nobody looks at it and we restart".split()) for _ in range(rng.randrange(6, 40))) + "."
    rows = [(i, rng.choice(RESIDUE) if i % 5 == 0 else rng.choice([*TALK, prose(), prose(), prose()]), None, f"s{i % 7}") for i in range(800)]
    rows += [(10_000 + k, t, None, "s1") for k, t in enumerate(TALK)] + [(20_000 + k, t, "A title", "s2") for k, t in enumerate(RESIDUE)] + [(None, "404 Not Found", None, None), (30_000, " ".join(prose() for _ in range(20_000)), None, "s1")]
    docs = residue.prepared(spark.createDataFrame(rows, "doc_id long, text string, title string, source string"), "doc_id", "text", "title", "source", None)
    model = residue.train(docs, validate=True)
    assert model.report["unseen_precision"] > 0.9 and model.report["unseen_recall"] > 0.9
    assert model.report["held_back_rows"] > 0
    got = {r["doc_id"] for r in residue.residue_paragraphs(docs, model).collect()}
    assert {20_000 + k for k in range(len(RESIDUE))} <= got
    assert got & {10_000 + k for k in range(len(TALK))} == set() and 30_000 not in got


def test_training_without_cases(spark):
    docs = residue.prepared(spark.createDataFrame([(1, "An answer.", None, "s")], "doc_id long, text string, title string, source string"), "doc_id", "text", "title", "source", None)
    model = residue.train(docs)
    assert residue.residue_paragraphs(docs, model).count() == 0
    assert residue.residue_paragraphs(docs.limit(0), residue.train(docs.limit(0))).count() == 0


def test_fences_are_paired_in_order():
    p = residue.paragraphs
    assert p("Before ```\n404 Not Found\n``` after.\n\nTail.") == ["Before ", " after.", "Tail."]
    assert p("Use `<pre>` for it.\n\nSecond.\n\nThird.") == ["Use  @code@  for it.", "Second.", "Third."]
    assert p("A\n\n```\nopen and never closed\n\nRest.") == ["A", "Rest."]
    assert p("<pre>a\n\nb</pre>\n\nRest.") == ["Rest."] and p("<code>open\n\nRest.") == ["Rest."]
    assert p("> quoted\n> more\n\n    code\n\nplain") == ["plain"]


def test_batch_scores_equal_single_ones():
    words = residue.Words()
    got = residue.read(["One two three.\n\nTwo two {{ x }}!", None, "", "A b c d e."], ["One", None, "t", None], [False, True, False, True], words)
    rng = np.random.RandomState(3)
    model = residue.Model(rng.randn(residue.WIDTH), 0.1, {})
    two, own_two, three, own_three = got.grams(words)
    ends = np.append(got.begin, len(got.flat))
    rows = [np.concatenate([*[words.pieces[t] for t in got.flat[ends[i] : ends[i + 1]]], two[own_two == i], three[own_three == i], got.shape[i]]) for i in range(len(got.plain))]
    assert len(rows) == 3 and np.allclose(model.score(rows), model.score_batch(got, words, [np.zeros(0), np.zeros(0)]))
