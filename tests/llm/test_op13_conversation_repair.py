import hashlib
import heapq
import itertools
import random
import re
import zlib

from oracle import same

from factloom.llm import conversation_repair as cr
from factloom.llm import queries

SOUND = re.compile(r"(s?(ua)+)?")


def plain_cheapest(rows):
    """Least cost and then least letters, by trying whole edit strings in that order: no use is made of the pattern's places."""
    heap, n = [(0, "", 0, "")], len(rows)
    done = set()
    while heap:
        cost, letters, at, roles = heapq.heappop(heap)
        if (letters, roles) in done:
            continue
        done.add((letters, roles))
        if at == n and SOUND.fullmatch(roles):
            return cost, letters
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        for who in "ua":
            heapq.heappush(heap, (cost + 2, letters + "I", at, roles + who))
        if at < n:
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, letters + "K", at + 1, roles + (initial or "?")))
                for who in "ua":
                    heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, roles + who))
    raise AssertionError("nothing is sound")


def test_short_conversations_equal_the_plain_search():
    kinds = [cr.Row(*x) for x in itertools.product(["s", "u", "a", "t", ""], ["", "truncated"])] + [cr.Row("u", "blank"), cr.Row("a", "duplicate")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert cr.cheapest(list(rows)) == plain_cheapest(list(rows))
    rnd = random.Random(1)
    for _ in range(150):
        rows = [rnd.choice(kinds) for _ in range(rnd.randrange(3, 6))]
        assert cr.cheapest(rows) == plain_cheapest(rows)


def applied(rows, letters):
    edits = cr.edited(letters)
    out = list(next(edits))
    for x in rows:
        out += edits.send(x)
    return out


def test_edits_make_sound_conversations():
    rnd = random.Random(2)
    for _ in range(300):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", ""]), f"t{k}.") for k in range(rnd.randrange(40))]
        cost, letters = cr.cheapest([cr.Row(x[0][:1], "") for x in rows])
        left = applied(rows, letters)
        assert SOUND.fullmatch("".join(x[1][:1] for x in left))
        assert sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in letters) == cost
        assert [x[0] for x in left] == [x for x in letters if x != "D"]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, audit string, digest string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        for _ in range(2 if way == 3 else 1):
            yield conv, turn, "user" if way == 4 else role, text


def expected(rows):
    groups = {x[0]: [] for x in rows}
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, found in groups.items():
        found.sort()
        turns = {x[1] for x in found if x[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for x in found:
            said = x[4].rstrip(cr.BLANK)
            faults.append("blank" if not said else "duplicate" if (x[2], x[4]) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((x[2], x[4]))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        few = [cr.Row(x[2][:1], f) for x, f in zip(found, faults, strict=True)]
        cost, letters = plain_cheapest(few) if len(few) < 6 else cr.cheapest(few)
        left = applied([(x[2], x[4]) for x in found], letters)
        digest = hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in left).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)
    return out


def awkward():
    rnd = random.Random(5)
    texts = ["", " \n", "one.", "two", "three! ", "four?\t", "\xa0", "long " * 4000 + ".", "漢字."]
    out = [(c, t, rnd.choice(["system", "user", "assistant", "assistant", "tool", ""]), rnd.choice(texts)) for c in range(60) for t in range(rnd.randrange(1, 7))]
    out += [(2, None, "user", "no turn."), (2, None, None, None), (None, 1, "user", "no id."), (None, None, "assistant", None), (70, None, "user", "x."), (3, 0, "user", "tie."), (3, 0, "user", "a tie.")]
    out += [out[5], out[5], out[9]]
    out += [(c, 0, "user", "dropped.") for c in range(100, 160) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return out + [(80, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(700)]


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame([(*x, 1, "old", "old") for x in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    wanted = expected(rows)
    assert len(got) == len(wanted)
    assert {x.conv_id: tuple(x)[1:] for x in got} == wanted
    assert sum(x[4] for x in wanted.values()) > 0 and any(not x[6] for x in wanted.values())


def test_query_matches_its_sql_twin(spark, sf_dir, tmp_path):
    same(queries.op13_conversation_repair(spark, sf_dir), sf_dir, queries.ORACLES["op13_conversation_repair"])
    spark.createDataFrame([x[:4] for x in awkward()], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op13_conversation_repair(spark, str(tmp_path)), str(tmp_path), queries.ORACLES["op13_conversation_repair"])


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {x.conv_id: tuple(x)[1:] for x in got.collect()} == expected(rows)


def test_empty_table_and_other_columns(spark):
    audits, rows = cr.repair(spark.createDataFrame([], SCHEMA))
    assert audits.count() == rows.count() == cr.digests(rows).count() == 0
    said = spark.createDataFrame([(1, 1, "assistant", "yes."), (1, 0, "user", "so?"), (1, 2, "user", "and")], "id int, at int, who string, said string")
    audits, rows = cr.repair(said, "id", "at", "who", "said")
    found = audits.first()
    assert (found.id, found.cost, found.audit, found.truncated) == (1, 3, "KKD", 1)
    assert [tuple(x) for x in rows.collect()] == [(1, 0, "K", "user", "so?"), (1, 1, "K", "assistant", "yes.")]
