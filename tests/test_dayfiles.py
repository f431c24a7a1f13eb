"""Day files as a data source: which file of a day is read, and that streams read each day once."""

import datetime
import io
import zipfile

from quantlake.sources import dayfiles


def put(folder, name, text, zipped=False):
    data = text.encode()
    if zipped:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("x.csv", text)
        data, name = held.getvalue(), name + ".zip"
    (folder / name).write_bytes(data)


def test_names_go_there_and_back():
    for day in (datetime.date(2020, 2, 29), datetime.date(2024, 7, 8)):
        for kind in dayfiles.NAMES:
            assert dayfiles.what(dayfiles.name_of(kind, day)) == (day, kind)
    assert dayfiles.what("readme.txt") is None and dayfiles.what("sec_bhavdata_full_99999999.csv") is None


def test_a_partition_a_day_of_the_preferred_kind(spark, tmp_path):
    d1, d2, d3, late = (datetime.date(2021, 1, k) for k in (4, 5, 6, 7))
    new = datetime.date(2024, 7, 8)
    for day, kinds in ((d1, ("equity", "delivery")), (d2, ("equity",)), (d3, ("unified",)), (new, ("unified", "delivery"))):
        for kind in kinds:
            put(tmp_path, dayfiles.name_of(kind, day), f" A ,B\n{kind},1\n,2\n", zipped=kind == "unified")
    (tmp_path / "notes.txt").write_text("no day")
    rows = dayfiles.read_days(spark, str(tmp_path))
    got = {(r["date"], r["kind"], r["row"]["A"], r["row"]["B"]) for r in rows.collect()}
    assert got == {(d, k, a, b) for d, k in ((d1, "delivery"), (d2, "equity"), (new, "unified")) for a, b in ((k, "1"), (None, "2"))}
    assert rows.rdd.getNumPartitions() == 3
    assert {r["date"] for r in dayfiles.read_days(spark, str(tmp_path), after="2021-01-04", upto="2021-12-31").collect()} == {d2}
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        dayfiles.stream_days(spark, str(tmp_path)).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return sorted({(r["date"], r["kind"]) for r in spark.read.parquet(target).collect()}), spark.read.parquet(target).count()

    assert run() == ([(d1, "delivery"), (d2, "equity"), (new, "unified")], 6)
    put(tmp_path, dayfiles.name_of("delivery", late), "A,B\nlate,1\n")  # before the last day read
    put(tmp_path, dayfiles.name_of("delivery", new + datetime.timedelta(1)), "A,B\nx,1\n")
    days, n = run()
    assert n == 7 and days[-1] == (new + datetime.timedelta(1), "delivery")


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert dayfiles.read_days(spark, str(tmp_path / "none")).count() == 0
