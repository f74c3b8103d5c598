"""Values that just meet a limit: what their queries' SQL says, in whole numbers."""

import datetime as dt

from castclip.operators import turns
from castclip.plans import catalog


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def edge_sounds(spark, folder):
    """Episode 3: samples of 0.1 and 0.7, of which floating sums of squares make less than 0.5; episode 4: 0.1 and 0.69; episode 5: 0.55 alone."""
    at = dt.datetime(2024, 1, 1)
    event = lambda amp, user, k: ((amp + 100) * 153 % 200, user, "view", at + dt.timedelta(minutes=k))  # noqa: E731  (17 * 153 is 1 mod 200)
    return events(spark, folder, [event(10, 3, 1), event(70, 3, 2), event(10, 4, 1), event(69, 4, 2), event(55, 5, 1)])


def test_windows_at_the_limit_are_voiced(spark, tmp_path):
    data = edge_sounds(spark, tmp_path)
    want = [(3, 0.5, True), (4, 0.493001, False), (5, 0.55, True)]
    assert sorted(map(tuple, catalog.str4_rms_windows(spark, data).collect())) == want
    assert {r["episode_id"] for r in catalog.str5_voice_windows(spark, data).collect()} == {5}


def test_streamed_windows_at_the_limit_are_voiced(spark, tmp_path):
    data = edge_sounds(spark, tmp_path)
    assert sorted(map(tuple, catalog.str4_rms_windows_live(spark, data).collect())) == [(3, 0.5, True), (4, 0.493001, False), (5, 0.55, True)]


def split(spark, start, end, gaps):
    """The edges in milliseconds of the pieces of one segment, whose lines have gaps of a second around the times given."""
    times = [start - 5000, *[t for g in gaps for t in (g - 500, g + 500)], end + 5000]
    lines = [(1, k, a / 1000, b / 1000) for k, (a, b) in enumerate(zip(times[::2], times[1::2], strict=True))]
    segs = spark.createDataFrame([(1, 0, "A", start / 1000, end / 1000)], "ep long, seg_idx long, speaker string, start double, end double")
    got = turns.split_long_segments(segs, spark.createDataFrame(lines, "ep long, line_no long, start double, end double"), 60.0, 0.9, ("ep",))
    return sorted((round(r["start"] * 1000), round(r["end"] * 1000)) for r in got.collect())


def test_segments_at_the_limits_of_length(spark):
    # in floating seconds more than a minute, less than four, and less than 24 seconds from the start
    assert 183.02 - 123.02 > 60 and 381.46 - 141.46 < 240 and 519.41 - 495.41 < 24
    assert split(spark, 123020, 183020, [150000]) == [(123020, 183020)]
    eight = [141460 + 26000 * k for k in range(1, 9)]
    assert split(spark, 141460, 381460, eight) == list(zip([141460, *eight], [*eight, 381460], strict=True))
    assert split(spark, 495410, 585410, [519410, 560000]) == [(495410, 519410), (519410, 560000), (560000, 585410)]
