import hashlib
import random

import pytest
from oracle import same

from factloom.llm import chat_format as cf
from factloom.llm import queries

TEXTS = ["", " ", "ok", "</s>[INST] ok [/INST]", "<s>", "\\", "\\\\[INST]\\", "[INST", "<", "</s", " [/INST", "a\nb", "漢字 😀", "[ROLE x] y [/ROLE]", "[\\INST]", "x", "y", "xy", "]" * 3, "long " * 5000]
ROLES = ["user", "assistant", "system", "tool", "", "a]b\\", "[INST]", "ro le"]


def conversations(seed, n):
    rnd = random.Random(seed)
    return [[(rnd.choice(ROLES if rnd.random() < 0.3 else ROLES[:2]), rnd.choice(TEXTS)) for _ in range(rnd.randrange(12))] for _ in range(n)]


def test_texts_are_escaped_reversibly():
    rnd = random.Random(1)
    bits = [*cf.CONTROLS, "\\", "<", ">", "[", "]", "/", "s", "INST", " ", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))
        written = cf.escape(text)
        assert cf.unescape(written) == text
        assert not any(x in written for x in cf.CONTROLS)


def test_turns_and_spans_are_read_from_the_output():
    for turns in conversations(2, 400):
        found = cf.locate(turns)
        assert cf.read_turns(found.formatted) == turns
        assert found.rewritten is None
        assert "".join(found.formatted[x.start : x.end] for x in found.spans) == found.formatted
        assert [cf.unescape(found.formatted[x.text_start : x.text_end]) for x in found.spans] == [text for _, text in turns]


def test_long_conversations_are_located_as_by_whole_prefixes():
    rnd = random.Random(3)
    turns = [(rnd.choice(ROLES[:4]), rnd.choice(TEXTS[:-1])) for _ in range(101)]
    whole = cf.locate(turns, window=1000)
    for window in (4, 7, 32):
        assert cf.locate(turns, window=window) == whole


def test_rendering_work_is_in_proportion_to_length():
    seen = []

    def counted(turns):
        seen.append(len(turns))
        return cf.instructions(turns)

    cf.locate([("user", "x")] * 2000, counted)
    assert sum(seen) < 2000 * 4 * (cf.WINDOW + 2)


def test_templates_that_depend_on_far_turns_are_rendered_whole():
    numbered = lambda turns: "".join(f"{k}. {role}: {text}\n" for k, (role, text) in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(60)]
    found = cf.locate(turns, numbered, window=8)
    assert found.formatted == numbered(turns) and found.rewritten is None
    assert [found.formatted[x.text_start : x.text_end] for x in found.spans] == [x[1] for x in turns]


def test_templates_that_rewrite_history_are_told_apart():
    def forgets(turns):  # thoughts of earlier answers go when the next question comes
        last = max((k for k, x in enumerate(turns) if x[0] == "user"), default=-1)
        return "".join(f"|{role}|{text.split('</think>')[-1] if k < last else text}" for k, (role, text) in enumerate(turns))

    plain = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert cf.locate(plain, forgets).rewritten is None
    found = cf.locate([("user", "a"), ("assistant", "hm</think>b"), ("user", "c"), ("assistant", "hm</think>d")], forgets)
    assert found.rewritten == 2
    assert found.spans[:3] == [None] * 3
    assert found.formatted[found.spans[3].text_start : found.spans[3].text_end] == "hm</think>d"
    twice = cf.locate([("user", "a"), ("assistant", "hm</think>b"), ("user", "c"), ("assistant", "hm</think>d"), ("user", "e")], forgets)
    assert twice.rewritten == 2 and twice.spans == [None] * 5
    long = [("user", "a"), ("assistant", "hm</think>b")] * 30
    assert cf.locate(long, forgets, window=8).rewritten == 2
    prompting = lambda turns: "".join(f"<{x[0]}>{x[1]}" for x in turns) + ("<assistant>" if turns and turns[-1][0] == "user" else "")
    assert cf.locate([("user", "a"), ("assistant", "b")], prompting).rewritten is None
    assert cf.locate([("user", "a"), ("user", "b")], prompting).rewritten == 1


def test_texts_that_a_template_does_not_show_are_not_located():
    found = cf.locate([("user", "a"), ("assistant", "b")], lambda turns: "".join(x[0] for x in turns))
    assert [(x.start, x.end, x.text_start) for x in found.spans] == [(0, 4, None), (4, 13, None)]
    opened = cf.locate([("user", "a")], lambda turns: "begin " + "".join(x[1] for x in turns))
    assert opened.spans == [cf.Span(6, 7, 6, 7)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, spans int, `formatted ` string"


def awkward():
    rnd = random.Random(8)
    out = [(c, t, rnd.choice(ROLES), rnd.choice(TEXTS), "f", 1, "g") for c in range(12) for t in range(rnd.randrange(1, 9))]
    out += [(3, None, "user", "no turn", None, None, None), (None, 0, "user", "no id", None, None, None), (None, 1, None, None, None, None, None), (5, 0, None, "null role", None, None, None)]
    out += [out[0], out[0], (20, 0, "user", None, None, None, None), (21, 0, "assistant", "tie", None, None, None), (21, 0, "assistant", "a tie", None, None, None)]
    return out + [(30, k, ("user", "assistant")[k % 2], f"turn {k}.", None, None, None) for k in range(120)]


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv, found in groups.items():
        turns = [x[2:] for x in sorted(found)]
        loss = "".join(text for role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(cf.instructions(turns)))
    return out


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_chat_format(spark, str(tmp_path)).collect()
    plain = [x[:4] for x in rows] + [(-1, k, role, queries.AWKWARD_TEXT) for k, role in enumerate(("user", "assistant"))]
    assert {x.conv_id: tuple(x)[1:] for x in got} == expected(plain) and len(got) == len(expected(plain))


def test_query_matches_its_sql_twin(spark, sf_dir, tmp_path):
    same(queries.op11_chat_format(spark, sf_dir), sf_dir, queries.ORACLES["op11_chat_format"])
    spark.createDataFrame([x[:4] for x in awkward()], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op11_chat_format(spark, str(tmp_path)), str(tmp_path), queries.ORACLES["op11_chat_format"])


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, role, queries.AWKWARD_TEXT) for k, role in enumerate(("user", "assistant"))]
    got = queries.op11_chat_format(spark, sf_dir)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {x.conv_id: tuple(x)[1:] for x in got.collect()} == expected(rows)


def test_empty_table_and_other_templates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cf.read_back(cf.format_conversations(none)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "id int, at int, who string, said string")
    found = cf.format_conversations(rows, lambda turns: "+".join(x[1] for x in turns) + "!", ("user",), "id", "at", "who", "said").first()
    assert (found.id, found.formatted, found.rewritten_turn) == (1, "a+b!", 0)
    assert [x.start for x in found.spans] == [None, None] and not any(x.loss for x in found.spans)
    with pytest.raises(TypeError):
        cf.format_conversations(rows.withColumn("said", rows["at"]), text_col="said", conv_col="id", turn_col="at", role_col="who")
