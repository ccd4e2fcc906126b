"""A sweep's state by key: three batches, stopped and resumed, against the batch answer."""

import json
import random

from lexigauge.streaming import sweeps


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(("task", "revision", "step", "item_id", "correct"), r, strict=True))) + "\n" for r in rows))


def plain(batches, size):
    """The same rule in a loop over batches."""
    out = {}
    for batch in batches:
        for t, r, step, item, c in sorted((x for x in batch if x[2] is not None and x[3] is not None), key=lambda x: (x[0], x[1], x[2], x[3], -(x[4] or 0))):
            k = out.setdefault((t, r), {"n": 0, "correct": 0.0, "finished": set(), "repeated": 0, "late": 0, "open": {}})
            items = k["open"].setdefault(step, set())
            if step in k["finished"] or len(items) >= size:
                k["late"] += 1
            elif item in items:
                k["repeated"] += 1
            else:
                items.add(item)
                k["n"] += 1
                k["correct"] += c or 0.0
        for k in out.values():
            k["finished"] |= {s for s, items in k["open"].items() if len(items) >= size}
    return {key: (k["n"], k["correct"], sorted(k["finished"]), k["repeated"], k["late"]) for key, k in out.items()}


BATCHES = [
    [("a", "r1", 1, 1, 1.0), ("a", "r1", 1, 2, 0.0), ("a", "r1", 1, 2, 1.0), ("b", "r1", 1, 1, 1.0), ("a", "r2", 5, 9, None), ("a", "r1", None, 3, 1.0)],
    [("a", "r1", 1, 3, 1.0), ("a", "r1", 2, 1, 1.0), ("a", "r1", 1, 1, 0.0), ("b", "r1", 1, None, 1.0), ("a", "r1", 1, 7, 1.0)],
    [("a", "r1", 1, 4, 1.0), ("a", "r1", 2, 2, 0.0), ("a", "r1", 2, 3, 1.0), ("a", "r2", 5, 8, 1.0), ("b", "r1", 1, 2, 1.0), ("b", "r1", 1, 3, 1.0), ("b", "r1", 1, 3, 1.0)],
]


def test_three_batches_stopped_and_resumed(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k, batch in enumerate(BATCHES):
        write(folder, f"b{k}", batch)
        scores = sweeps.score_stream(spark, str(folder), sweeps.STEP_SCORES)
        sweeps.sweep_states(scores, 3, out, checkpoint)  # each run goes on from the last one's state
        got = {(r.task, r.revision): (r.n, r.correct, r.finished, r.repeated, r.late) for r in sweeps.progress(spark, out).collect()}
        assert got == plain(BATCHES[: k + 1], 3)
    sweeps.sweep_states(sweeps.score_stream(spark, str(folder), sweeps.STEP_SCORES), 3, out, checkpoint)  # nothing new
    assert sweeps.progress(spark, out).count() == 3
    last = {(r.task, r.revision): r for r in sweeps.progress(spark, out).collect()}
    assert last["a", "r1"].finished == [1, 2] and last["a", "r1"].late == 2 and last["b", "r1"].finished == [1]


def test_a_batch_is_one_whatever_arrow_batches_it_comes_in(spark, tmp_path):
    rng = random.Random(3)
    batches = [[("a", rng.choice(["r1", "r2"]), rng.randint(1, 4), rng.randint(1, 40), rng.choice([None, 0.0, 1.0])) for _ in range(n)] for n in (60, 300)]
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        for k, batch in enumerate(batches):
            write(folder, f"b{k}", batch)
            sweeps.sweep_states(sweeps.score_stream(spark, str(folder), sweeps.STEP_SCORES), 12, out, checkpoint)
            got = {(r.task, r.revision): (r.n, r.correct, r.finished, r.repeated, r.late) for r in sweeps.progress(spark, out).collect()}
            assert got == plain(batches[: k + 1], 12)
    finally:
        spark.conf.set(name, before)
