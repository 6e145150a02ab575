"""Consolidation against a plain sequential reading of the rules."""

import random

from pyspark.sql import functions as F

from sessionloom.functions import keys
from sessionloom.operators import consolidate, screenshots
from sessionloom.operators.sequence import order_sessions

SCRIPT = [
    "key_press(Key.backspace)", "key_press('h')", "key_press('i')", "key_press(Key.backspace)", "key_press(Key.space)", "click_left(5.0, 5.0)",
    "scroll(1.0, 1.0, dx=0.00, dy=-1.00)", "scroll(1.0, 1.0, dx=0.00, dy=-1.00)", "scroll(2.0, 1.0, dx=0.00, dy=-1.00)", "key_press(Key.cmd)", "key_press('c')", "key_press(Key.enter)",
]


def events(spark, actions, session="s"):
    rows = [(session, i, float(i), a) for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, "session_id string, line_no bigint, ts double, action string")


def test_run_merge_script(spark):
    got = [r.action for r in consolidate.merge_runs(events(spark, SCRIPT)).df.orderBy("run_id").collect()]
    assert got == [
        "key_press('Key.backspaceh ')", "click_left(5.0, 5.0)", "scroll(1.0, 1.0, dx=0.00, dy=-1.00)", "scroll(2.0, 1.0, dx=0.00, dy=-1.00)",
        "key_press('Key.cmd+c')", "key_press('Key.enter+')",
    ]


def test_backspace_cuts_only_the_last_token(spark):
    df = spark.createDataFrame([(["a", "b", "Key.backspace", "Key.backspace", "c"],), (["Key.backspace", "Key.backspace"],)], "t array<string>")
    got = [r.v for r in df.select(keys.compose_tokens(F.col("t")).alias("v")).collect()]
    assert got == ["ac", "Key.backspac"]


def clicks(spark, rows):
    data = [("s", i, f"click_left({x}.0, 0.0)" if x is not None else "scroll(1)", "b", f"a{i}", float(d), 0.0, float(i)) for i, (x, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "session_id string, i bigint, action string, before string, after string, time_diff double, time_range double, time_after double")
    return order_sessions(df, "session_id", "i")


def greedy(rows, keep_last=True):
    out, i, n = [], 0, len(rows)
    while i < n:
        if i + 1 < n and rows[i][0] is not None and rows[i + 1][0] is not None and rows[i + 1][1] <= 0.5 and abs(rows[i + 1][0] - rows[i][0]) < 10:
            out.append((i, True))
            i += 2
        else:
            if keep_last or i + 1 < n:
                out.append((i, False))
            i += 1
    return out


def test_double_clicks_match_a_left_to_right_scan(spark):
    rng = random.Random(3)
    for length in (1, 2, 3, 4, 9, 40):
        rows = [(rng.choice([0, 5, 10, 15, None]), rng.choice([0.1, 0.5, 0.6])) for _ in range(length)]
        for keep_last in (True, False):
            got = [(r.i, r.is_double) for r in consolidate.merge_double_clicks(clicks(spark, rows), keep_last=keep_last).df.orderBy("i").collect()]
            assert got == greedy(rows, keep_last)


def test_screenshots_are_claimed_once_nearest_and_in_order(spark):
    acts = spark.createDataFrame(
        [("s", 1, 0, 10.0, "click(1)"), ("s", 2, 0, 10.5, "click(1)"), ("s", 3, 0, 20.0, "key_press('a')")], "session_id string, run_id bigint, pos bigint, ts double, action string"
    )
    runs = acts.select("session_id", "run_id", F.col("ts").alias("ts_before"), F.col("ts").alias("ts_after"))
    names = ["9.9_click(1)_before.jpg", "10.6_click(1)_before.jpg", "11.0_click(1)_after.jpg", "12.0_click(1)_after.jpg", "18.5_key_press('a')_first.jpg", "20.1_key_press('a')_first.jpg", "21.0_key_press('a')_final.jpg"]
    shots = spark.createDataFrame([("s", "d/" + n) for n in names], "session_id string, path string")
    got = {r.run_id: (r.before, r.after) for r in screenshots.match_states(runs, acts, shots).collect()}
    assert got[1] == ("d/9.9_click(1)_before.jpg", "d/11.0_click(1)_after.jpg")
    # 12.0 is exactly 1.5 s after the second click; nothing else is left for its after state.
    assert got[2] == ("d/10.6_click(1)_before.jpg", "d/12.0_click(1)_after.jpg")
    assert got[3] == ("d/20.1_key_press('a')_first.jpg", "d/21.0_key_press('a')_final.jpg")


def test_tolerance_is_strict(spark):
    acts = spark.createDataFrame([("s", 1, 0, 10.0, "click(1)")], "session_id string, run_id bigint, pos bigint, ts double, action string")
    shots = spark.createDataFrame([("s", "12.0_click(1)_before.jpg")], "session_id string, path string")
    assert screenshots.candidates(acts, shots).count() == 0


def _served(rows):
    """Asks in order, each the best screenshot that is left."""
    taken, out = set(), {}
    for ask in sorted({(s, a) for s, a, _, _ in rows}):
        free = sorted((w, p) for s, a, w, p in rows if (s, a) == ask and (s, p) not in taken)
        if free:
            taken.add((ask[0], free[0][1]))
            out[ask] = free[0][1]
    return out


def test_claims_in_rounds_agree_with_one_after_another(spark):
    rnd = random.Random(6)
    rows = {}
    for session in ("a", "b", "c"):
        for ask in range(150):
            near = rnd.sample(range(max(0, ask - 4), ask + 4), rnd.randint(0, 4))
            rows |= {(session, ask, f"p{n // 2}"): rnd.randint(0, 2) for n in near}
    rows = [(s, a, w, p) for (s, a, p), w in rows.items()]
    pairs = spark.createDataFrame(rows, "session_id string, ask long, w int, path string").select("session_id", "ask", F.struct("w").alias("wish"), "path")
    found, rounds = screenshots.claim(pairs)
    assert {(r.session_id, r.ask): r.path for r in found.collect()} == _served(rows)
    assert rounds <= 15


def test_rounds_follow_rivals_not_rows(spark):
    apart = [("s", a, w, f"p{a // 2}_{w ^ a % 2}") for a in range(2_000) for w in (0, 1)]
    pairs = lambda rows: spark.createDataFrame(rows, "session_id string, ask long, w int, path string").select("session_id", "ask", F.struct("w").alias("wish"), "path")
    found, rounds = screenshots.claim(pairs(apart))
    assert found.count() == 2_000 and rounds <= 2
    rivals = [("s", a, w, f"p{w}") for a in range(6) for w in range(4)]
    found, rounds = screenshots.claim(pairs(rivals))
    assert {r.ask: r.path for r in found.collect()} == {a: f"p{a}" for a in range(4)} and rounds <= 6
    assert screenshots.claim(pairs([]))[0].count() == 0
