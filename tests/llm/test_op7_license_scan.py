import random
import re
import textwrap
import time

from frames import empty, frame, rows
from oracle import same

from factloom.llm import license_scan as ls
from factloom.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain(text, templates=ls.TEMPLATES):
    """Places and met labels by comparing every stretch of words with every template."""
    found = words(text)
    places = sorted((k, label) for phrase, label in ls.PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split())
    met = []
    for template, label in templates.items():
        want, span = set(words(template)), ls.span_of(template)
        shares = [(len(want & set(found[k : k + span])), -k) for k in range(len(found)) if found[k] in want]
        if shares and max(shares)[0] / len(want) >= ls.THRESHOLD - 1e-9:
            met.append((-max(shares)[1], label, max(shares)[0] / len(want)))
    return len(found), places, sorted(met)


MIT, BSD = list(ls.TEMPLATES)[:2]
wrapped = lambda text, width: "\n".join(textwrap.wrap(text, width))

TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "x\nReleased under the MIT License.\nAll rights\nreserved. all RIGHTS reserved",
    "cc by cc by-sa CCBY cc\nby",
    "This work is licensed under the GNU General Public License, version 3.",
    "This library is licensed under the GNU Lesser General Public License, too.",
    "Redistribution and use in source and binary forms, with modification, are permitted",
    "General Public Licence; general public license general public license",
    "Kelvin ẞ all\x7frights\x00reserved",
]


def test_scan_equals_a_plain_comparison(spark):
    table = [(k, x) for k, x in enumerate(TEXTS * 2)] + [(100 + k, x[1]) for k, x in enumerate(rows())]
    got = {x.doc_id: x for x in ls.scan(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    for own, text in table:
        x = got[own]
        assert (x.n_words, [tuple(p) for p in x.places], sorted(map(tuple, x.matches))) == plain(text or "")


def test_query_matches_its_sql_twin(spark):
    sf_dir = "/root/testdata/sf0.01"
    same(queries.op7_license_scan(spark, sf_dir), sf_dir, ls.scan_sql())


def test_awkward_rows(spark):
    assert ls.summary(ls.scan(frame(spark))).count() == len(rows())
    assert ls.scan(empty(spark)).count() == 0
    none = ls.summary(ls.scan(spark.createDataFrame([(1, None)], "doc_id int, text string"))).first()
    assert (none.n_words, none.n_base, none.first_word, none.last_word, none.base_labels, none.labels, none.score) == (0, 0, None, None, "", "", 0.0)


def test_wrapped_notices_are_found(spark):
    table = [(k, wrapped(x, width)) for k, (x, width) in enumerate((x, w) for x in (MIT, BSD) for w in (30, 60, 72, 80))]
    got = {x.doc_id: x.labels for x in ls.summary(ls.scan(spark.createDataFrame(table, "doc_id bigint, text string"))).collect()}
    assert all(got[k] == ("mit" if k < 4 else "bsd") for k in got)
    for text in (MIT, BSD):
        cut = " ".join(text.split()[: len(text.split()) // 2])
        assert not any(x[2] >= ls.THRESHOLD and x[1] == "isc" for x in plain(cut)[2])


def test_many_templates_cost_little_more_and_equal_the_plain_comparison():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    templates = {" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40))): f"t{k}" for k in range(500)}
    notices = list(templates)
    texts = []
    for k in range(60):
        body = [rnd.choice(vocabulary) for _ in range(300)]
        if k % 2:
            notice = rnd.choice(notices).split()
            del notice[:: rnd.choice([5, 15, 50])]
            body[100:100] = notice
        texts.append(" ".join(body))
    frequency = {}
    for text in texts:
        for word in set(ls.words_of(text)):
            frequency[word] = frequency.get(word, 0) + 1
    taken = []
    for some in (dict(list(templates.items())[:10]), templates):
        scanner = ls.Scanner(some, ls.PHRASES, ls.THRESHOLD, frequency)
        began = time.process_time()
        got = [scanner.matches(ls.words_of(x)) for x in texts]
        taken.append(time.process_time() - began)
        assert got == [plain(x, some)[2] for x in texts]
    assert sum(map(bool, got)) >= 15
    assert taken[1] < 25 * taken[0]  # fifty times the templates
