import json

from tests.families import TAIL, frame, line, system

from prefixlens.operators import projection as PJ
from prefixlens.operators import session as S
from prefixlens.plans.pipeline import analyse_file, analyse_loaded
from prefixlens.sources import records as R
from prefixlens.streaming import live


def user(*texts):
    return [{"role": "user", "content": t} for t in texts]


def test_turns_windows_and_late_rows(spark, tmp_path):
    at = lambda minute, words, session="s": json.dumps({**json.loads(line(user(*words), 0, session)), "captured_at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"})
    first = [at(1, "a"), at(3, "ab"), at(5, "ba"), at(7, "x"), "broken", ""]
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "1.ndjson").write_text("\n".join(first) + "\n")
    loaded = live.load(live.stream_lines(spark, str(folder), 1))
    turns = live.session_turns(loaded, delay="10 minutes").writeStream.format("memory").queryName("turns").outputMode("append").start()
    counts = live.window_counts(loaded).writeStream.format("memory").queryName("counts").outputMode("append").start()
    kept = []
    skips = live.close_windows(loaded, lambda df, epoch: kept.extend(r.skip_code for r in df.where("skip_code IS NOT NULL").collect()), str(tmp_path / "check"))
    queries = (turns, counts, skips)
    try:
        for q in queries:
            q.processAllAvailable()
        (folder / "2.ndjson").write_text(at(200, "zz", "other") + "\n")
        for q in queries:
            q.processAllAvailable()
        (folder / "3.ndjson").write_text(at(2, "late") + "\n" + at(400, "zzz", "other") + "\n")
        for q in queries:
            q.processAllAvailable()
        rows = spark.sql("SELECT * FROM turns").collect()
        got = [(r.event_type, r.lcp_units, r.lcp_bytes, r.next_total_bytes) for r in rows if r.session_key == "s" and not r.late]
        batch = S.session_events(PJ.sequences(PJ.project(R.identified(R.load_lines(frame(spark, first)))))).orderBy("next_sequence").collect()
        assert got == [(r.event_type, r.lcp_units, r.lcp_bytes, r.next_total_bytes) for r in batch] and [g[0] for g in got] == ["append", "reorder", "reset"]
        assert spark.sql("SELECT records FROM counts WHERE time_window_key = 1767225600").first().records == 4
        assert sorted(kept) == ["EmptyLine", "InvalidJson"]
    finally:
        for q in queries:
            q.stop()


def test_a_window_over_two_files_is_analysed_whole(spark, tmp_path):
    at = lambda hour, i: json.dumps({**json.loads(line(system(f"run id {i}{i}{i}", TAIL))), "captured_at": f"2026-01-01T{hour:02d}:0{i}:00Z"})
    whole = [at(1, i) for i in range(4)]
    (tmp_path / "all.ndjson").write_text("\n".join(whole) + "\n")
    batch = analyse_file(spark, str(tmp_path / "all.ndjson"))
    relations = lambda a: (sorted((r.cohort_id, r.request_id) for r in a.cohorts.collect()), sorted(map(str, a.defects.collect())))
    want = relations(batch)
    assert len(want[0]) == 4
    folder, got, behind = tmp_path / "landing", [], []
    folder.mkdir()
    (folder / "1.ndjson").write_text("\n".join(whole[:2]) + "\n")
    loaded = live.load(live.stream_lines(spark, str(folder), 1))
    q = live.close_windows(loaded, lambda df, epoch: got.append((epoch, relations(analyse_loaded(df)))), str(tmp_path / "check"), late=lambda df, epoch: behind.append((epoch, df.count())))
    try:
        q.processAllAvailable()
        for name, lines in (("2", whole[2:]), ("3", [at(3, 0)]), ("4", [at(1, 5), at(3, 1)])):
            (folder / f"{name}.ndjson").write_text("\n".join(lines) + "\n")
            q.processAllAvailable()
    finally:
        q.stop()
    assert got == [(2, want)] and behind == [(3, 1)]


def test_turns_of_one_instant_keep_the_order_of_the_lines(spark, tmp_path):
    rows = [line(user(*("abc"[: i % 3 + 1] + f"{i}")), 0, "s") for i in range(40)]  # all at one instant
    end = json.dumps({**json.loads(line(user("z"), 0, "other")), "captured_at": "2026-01-01T09:00:00Z"})
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "1.ndjson").write_text("\n".join(rows[:25]) + "\n")
    loaded = live.load(live.stream_lines(spark, str(folder), 1))
    assert loaded.isStreaming
    q = live.session_turns(loaded).writeStream.format("memory").queryName("instant").outputMode("append").start()
    sink = live.close_windows(loaded, live.window_sink(str(tmp_path / "out")), str(tmp_path / "check"))
    try:
        for name, lines in (("2", rows[25:]), ("3", [end]), ("4", [end.replace("T09", "T10")])):
            for x in (q, sink):
                x.processAllAvailable()
            (folder / f"{name}.ndjson").write_text("\n".join(lines) + "\n")
            for x in (q, sink):
                x.processAllAvailable()
    finally:
        q.stop()
        sink.stop()
    got = [(r.event_type, r.lcp_units, r.next_total_bytes) for r in spark.sql("SELECT * FROM instant WHERE session_key = 's'").collect()]
    batch = S.session_events(PJ.sequences(PJ.project(R.identified(R.load_lines(frame(spark, rows)))))).orderBy("next_sequence").collect()
    want = [(r.event_type, r.lcp_units, r.next_total_bytes) for r in batch]
    assert got == want and len(want) == 39
    kept = spark.read.parquet(str(tmp_path / "out" / "session_events")).where("session_key = 's'")
    assert sorted(kept.select("event_type", "lcp_units", "next_total_bytes").collect()) == sorted(want)
    # the same batch again leaves what is there
    before = kept.count()
    batch_id = kept.first().batch
    live.window_sink(str(tmp_path / "out"))(R.load_lines(frame(spark, rows)), batch_id)
    assert spark.read.parquet(str(tmp_path / "out" / "session_events")).where("session_key = 's'").count() == before
