import datetime as dt
import random

from factloom.operators import intervals


def day(k):
    return dt.date(1969, 12, 1) + dt.timedelta(days=k)


def test_overlaps_equal_all_pairs_and_need_no_nested_loop(spark):
    rnd = random.Random(1)

    def rows(n, tag):
        out = []
        for k in range(n):
            first = rnd.randrange(400)
            out.append((rnd.choice(["hot"] * 4 + ["a", None]), f"{tag}{k}", day(first), day(first + rnd.choice([0, 3, 40, 300, -5]))))
        return [*out, out[0], ("hot", "none", None, day(3)), ("hot", "open", day(3), None)]

    left, right = rows(60, "l"), rows(50, "r")
    schema = "key string, name string, first date, last date"
    frames = [spark.createDataFrame(x, schema) for x in (left, right)]
    sound = lambda x: None not in x and x[2] <= x[3]
    meets = lambda a, b: sound(a) and sound(b) and a[2] <= b[3] and b[2] <= a[3]
    for width in (7, 90, 1000):
        found = intervals.overlaps(*frames, ["key"], width)
        assert sorted((x.left_name, x.right_name) for x in found.collect()) == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and meets(a, b))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    loose = intervals.overlaps(*(x.drop("key") for x in frames), [], 60)
    keyed = [x for x in left if x[1:]], [x for x in right]
    wanted = sorted((a[1], b[1]) for a in keyed[0] for b in keyed[1] if sound(("k", *a[1:])) and sound(("k", *b[1:])) and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((x.left_name, x.right_name) for x in loose.collect()) == wanted
    assert intervals.overlaps(frames[0].where("false"), frames[1], ["key"]).count() == 0


def test_last_before_equals_a_plain_search(spark):
    rnd = random.Random(2)
    moment = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(3000))
    states = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), moment(), rnd.randrange(5), f"s{k}") for k in range(200)]
    states += [states[0], ("hot", None, 1, "no time"), ("a", dt.datetime(1960, 1, 1), None, "early")]
    moments = [(rnd.choice(["hot"] * 5 + ["a", "b", "c", None]), moment(), k) for k in range(200)]
    moments += [(states[5][0], states[5][1], 900), ("hot", None, 901), moments[0], ("a", dt.datetime(1959, 1, 1), 902)]
    left = spark.createDataFrame(moments, "key string, ts timestamp, id int")
    right = spark.createDataFrame(states, "key string, ts timestamp, grade int, name string")

    def last(key, ts):
        if key is None or ts is None:
            return (None, None)
        known = [(s[1], (s[2] is not None, s[2] or 0), s[3], s[2]) for s in states if s[0] == key and s[1] is not None and s[1] <= ts]
        return (max(known)[3], max(known)[2]) if known else (None, None)

    for cell_days in (1, 30, 100_000):
        got = intervals.last_before(left, right, ["key"], "ts", ["grade", "name"], cell_days)
        assert got.columns == ["key", "ts", "id", "grade", "name"]
        assert sorted(((x.id, x.grade, x.name) for x in got.collect()), key=repr) == sorted(((k, *last(key, ts)) for key, ts, k in moments), key=repr)
    assert intervals.last_before(left.where("false"), right, ["key"], "ts", ["name"]).count() == 0
    assert intervals.last_before(left, right.where("false"), ["key"], "ts", ["name"]).where("name IS NOT NULL").count() == 0
