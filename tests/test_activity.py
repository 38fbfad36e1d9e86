"""Dedup, duplicate report, step counts and never-active learners on hand-made rows."""

import random

import pytest
from conftest import day
from coursepulse import model
from coursepulse.operators import activity as act


def test_steps_are_text(activity):
    rows = activity([("a", "1.1", 1, None), ("a", "1.10", 1, None)])
    assert act.clean_step_activity(rows).count() == 2


@pytest.mark.parametrize("step_fixes_week", [False, True])
def test_latest_row_is_kept(activity, step_fixes_week):
    rows = activity(
        [("a", "1.1", 1, None), ("a", "1.1", 1, 3), ("a", "1.1", None, None), ("a", "1.1", 2, None)]
    )
    (kept,) = act.clean_step_activity(rows, step_fixes_week).collect()
    assert (kept.first_visited_at, kept.last_completed_at, kept.step_completed) == (day(1), day(3), True)


def test_later_visit_beats_earlier_completion(activity):
    rows = activity([("a", "1.1", 1, 2), ("a", "1.1", 5, None)])
    (kept,) = act.clean_step_activity(rows).collect()
    assert (kept.first_visited_at, kept.step_completed) == (day(5), False)


def test_all_null_times_keep_one_row(activity):
    rows = activity([("a", "1.1", None, None), ("a", "1.1", None, None)])
    (kept,) = act.clean_step_activity(rows).collect()
    assert kept.last_completed_at is None and kept.step_completed is False


def test_tie_prefers_completion_then_first_visit(activity):
    rows = activity([("a", "1.1", 4, None), ("a", "1.1", 2, 4), ("a", "1.1", 3, 4), ("a", "1.1", None, 4)])
    (kept,) = act.clean_step_activity(rows).collect()
    assert (kept.first_visited_at, kept.last_completed_at) == (day(3), day(4))


def test_dedup_ignores_row_order_and_is_idempotent(spark, activity):
    rng = random.Random(3)
    maybe = [None, *range(1, 6)]
    rows = [
        (rng.choice("abc"), rng.choice(["1.1", "1.2", "2.1"]), rng.choice(maybe), rng.choice(maybe))
        for _ in range(300)
    ]
    results = []
    for _ in range(3):
        rng.shuffle(rows)
        clean = act.clean_step_activity(activity(rows).repartition(rng.randint(1, 7)))
        results.append(sorted(map(str, clean.collect())))
    assert results[0] == results[1] == results[2]
    again = act.clean_step_activity(act.clean_step_activity(activity(rows)))
    assert sorted(map(str, again.collect())) == results[0]


def test_dedup_matches_brute_force(activity):
    rng = random.Random(5)
    maybe = [None, *range(1, 6)]
    rows = [
        (rng.choice("ab"), rng.choice(["1.1", "1.2"]), rng.choice(maybe), rng.choice(maybe)) for _ in range(200)
    ]
    # One key holds a third of the rows.
    rows += [("hot", "1.1", rng.choice(maybe), rng.choice(maybe)) for _ in range(100)]

    def order(row):
        _, _, visited, completed = row
        touch = completed if completed is not None else visited
        return tuple(-1 if v is None else v for v in (touch, completed, visited))

    best = {}
    for row in rows:
        key = row[:2]
        best[key] = max(best.get(key, row), row, key=order)
    expected = {(k[0], k[1], day(r[2]), day(r[3])) for k, r in best.items()}
    got = act.clean_step_activity(activity(rows))
    assert {(r.learner_id, r.step, r.first_visited_at, r.last_completed_at) for r in got.collect()} == expected


def test_week_comes_from_the_kept_row(activity):
    rows = activity([("a", "1.1", 1, None, "run-1", 1), ("a", "1.1", 2, None, "run-1", None)])
    (kept,) = act.clean_step_activity(rows).collect()
    assert kept.week_number is None


def test_inconsistent_steps(activity):
    rows = activity(
        [
            ("a", "1.1", 1, None, "run-1", 1), ("b", "1.1", 1, None, "run-1", None),
            ("a", "1.2", 1, None, "run-1", 1), ("b", "1.2", 1, None, "run-1", 2),
            ("a", "1.3", 1, None, "run-1", 1), ("b", "1.3", 1, None, "run-1", 1),
            ("a", "1.4", 1, None, "run-1", None), ("b", "1.4", 1, None, "run-1", None),
        ]
    )
    assert {r.step for r in model.inconsistent_steps(rows).collect()} == {"1.1", "1.2"}


def test_duplicates(activity):
    rows = activity([("a", "1.1", 1, None), ("a", "1.1", 2, None), ("a", "1.2", 1, None), ("b", "1.1", 1, None)])
    (dup,) = act.duplicate_groups(rows).collect()
    assert (dup.learner_id, dup.step, dup.n) == ("a", "1.1", 2)


def test_run_sizes_agree_with_separate_counts(activity):
    rows = activity(
        [("a", "1.1", 1, 1), ("a", "2.1", 1, 1), ("b", "1.2", 1, 1), ("a", "2.1", 1, 1, "run-2"),
         ("a", "3.1", 1, 1, "run-1", None)]
    )
    clean = act.clean_step_activity(rows)
    sizes = {r.course_run: (r.total_steps_in_course, r.week1_total_steps) for r in act.run_sizes(clean).collect()}
    assert sizes == {"run-1": (4, 2), "run-2": (1, None)}
    totals = {r.course_run: r.total_steps_in_course for r in act.count_steps(clean).collect()}
    week = act.count_steps(act.activity_in_week(clean), "week1_total_steps")
    assert totals == {"run-1": 4, "run-2": 1}
    assert {r.course_run: r.week1_total_steps for r in week.collect()} == {"run-1": 2}


def test_never_active(activity, enrolments):
    rows = activity([("a", "1.1", 1, None), ("a", "1.1", 1, None, "run-2"), ("stranger", "1.1", 1, None)])
    people = enrolments([("a", None), ("a", None, "run-2"), ("b", None), ("c", None)])
    row = act.never_active(people, rows).first()
    assert (row.enrolled_learners, row.active_learners, row.never_active) == (3, 2, 1)


def test_input_checks(activity, enrolments):
    rows = activity([("a", "1.1", 1, None)])
    with pytest.raises(ValueError, match="step_number"):
        model.require_columns(rows.drop("step_number"), model.CSV_TABLES["step-activity"].required, "activity")
    with pytest.raises(TypeError):
        model.require_table(None, "activity")
    model.require_keys(rows, model.STEP_KEYS, "activity")
    with pytest.raises(ValueError, match="learner_id"):
        model.require_keys(activity([(None, "1.1", 1, None)]), model.STEP_KEYS, "activity")
    with pytest.raises(ValueError, match="b, c"):
        model.require_names(["a", "b", "c"], ["a"])
