import random

from factloom.operators import quotes
from factloom.plans import catalog


def plain(quote, text):
    """The least distance of a quotation to any stretch of the words of a text, by trying all of them."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    return min(distance(quote, text[i:j]) for i in range(len(text) + 1) for j in range(i, min(len(text), i + 2 * len(quote)) + 1))


def located(quote, text):
    words = quotes.words_of(text)
    where = {}
    for k, (word, _, _) in enumerate(words):
        where.setdefault(word, []).append(k)
    return quotes.place_of(quote, words, where)


def test_damaged_quotations_are_found_at_the_least_distance():
    rnd = random.Random(1)
    letters = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    for _ in range(150):
        text = [rnd.choice(letters) for _ in range(60)]
        at, n = rnd.randrange(45), rnd.randrange(6, 13)
        said = text[at : at + n]
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(said))
            said[k : k + rnd.randrange(2)] = rnd.choice([[], ["wrong"], [rnd.choice(letters), "wrong"]])
        found = located(" ".join(said), ", ".join(text).upper())
        least = plain(said, text)
        assert found is not None and found[2] == least, (said, text, found, least)
        stretch = [x[0] for x in quotes.words_of(", ".join(text).upper()[found[0] : found[1]])]
        assert plain(said, stretch) == least


def test_alignment_equals_the_plain_search():
    rnd = random.Random(2)
    for _ in range(200):
        quote, text = ([rnd.choice("abc") for _ in range(rnd.randrange(1, n))] for n in (6, 12))
        distance, start, end = quotes.aligned(quote, text)
        assert distance == plain(quote, text) == plain(quote, text[start:end])


def test_nulls_parts_and_misses(spark):
    rows = [(1, 1, "A fox ... off"), (2, 1, "no such words"), (3, 9, "A fox"), (4, 1, None), (5, 1, "..."), (6, 2, "fox"), (7, 1, "FOX, ran!"), (7, 1, "FOX, ran!")]
    cited = spark.createDataFrame(rows, "quote_id int, snippet_id int, quote string")
    texts = spark.createDataFrame([(1, "Then a fox ran off."), (2, None)], "snippet_id int, text string")
    got = sorted(((x.quote_id, x.part, x.start, x.end, x.distance) for x in quotes.quote_places(cited, texts).collect()), key=repr)
    assert got == [(1, 0, 5, 10, 0), (1, 1, 15, 18, 0), (2, 0, None, None, None), (3, 0, None, None, None), (4, 0, None, None, None), (5, 0, None, None, None), (6, 0, None, None, None), (7, 0, 7, 14, 0), (7, 0, 7, 14, 0)]
    assert quotes.quote_places(cited.where("false"), texts).count() == 0


def test_query_finds_what_it_quotes(spark, sf_dir):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.quote_places(spark, sf_dir).collect()
    assert len(got) == len(texts)
    placed = [x for x in got if x.start is not None]
    assert len(placed) > 0.95 * len(got)
    for x in placed:
        assert x.distance <= (x.quote_id % 3 > 0)
        if x.quote_id % 3 == 0:
            assert x.distance == 0 and len(quotes.words_of(texts[x.snippet_id][x.start : x.end])) <= catalog.QUOTE_WORDS
