import json

import pytest

from groundswell import __main__ as cli
from groundswell import frames
from groundswell.functions import projection


def table():
    return frames.FrameTable("1", "test", {"tropo": {"mode": "auto"}}, {"00042": {"uncertainty": {"k_grid": 2.5}, "processing_options": {"downsample_method": "median"}}})


def test_merging_replaces_leaves_and_merges_groups():
    base = {"a": {"x": 1, "y": [1]}, "b": 2}
    out = frames.merged(base, {"a": {"x": 5}, "b": {"z": 3}})
    assert out == {"a": {"x": 5, "y": [1]}, "b": {"z": 3}} and base == {"a": {"x": 1, "y": [1]}, "b": 2}
    out["a"]["y"].append(2)
    assert base["a"]["y"] == [1] and frames.paths({"a": {"x": 1, "b": {"c": 2}}}) == {"a.x": 1, "a.b.c": 2}


def test_precedence_is_default_frame_extra():
    t = table()
    assert t.of(42, {"tropo": {"mode": "off"}})["tropo"]["mode"] == "off" and t.of("7") == {"tropo": {"mode": "auto"}}
    p = t.params(42)
    assert p["calibration_options"]["uncertainty"]["k_grid"] == 2.5 and p["calibration_options"]["tropo"]["mode"] == "auto"
    assert p["processing_options"]["downsample_method"] == "median" and t.frames() == [42]


@pytest.mark.parametrize("extra", [{"tropo": {"mode": "wild"}}, {"uncertainty": {"k_grid": -1}}, {"unheard": 1}, {"weights": {"robust": 1}}, {"tropo": {"relief_off_meters": 9000}}])
def test_wrong_options_are_refused(extra):
    with pytest.raises(ValueError):
        table().params(42, extra)


def test_table_goes_through_a_file(tmp_path):
    table().write(tmp_path / "t.json")
    assert frames.FrameTable.load(tmp_path / "t.json") == table()
    table().write(tmp_path / "folded.json", folded=True)
    assert json.loads((tmp_path / "folded.json").read_text())["data"]["00042"]["tropo"] == {"mode": "auto"}
    (tmp_path / "odd.json").write_text('{"version": "1", "more": 1}')
    with pytest.raises(ValueError):
        frames.FrameTable.load(tmp_path / "odd.json")
    assert frames.packaged(tmp_path, "t.json").is_file()
    with pytest.raises(FileNotFoundError):
        frames.packaged(tmp_path, "../" + tmp_path.name + "/t.json")


def test_command_line(tmp_path, capsys):
    assert cli.main(["config", str(tmp_path / "c.json")]) == 0 and json.loads((tmp_path / "c.json").read_text()) == frames.DEFAULTS
    table().write(tmp_path / "t.json")
    assert cli.main(["params", str(tmp_path / "t.json"), "42"]) == 0 and '"k_grid": 2.5' in capsys.readouterr().out
    assert cli.main(["run", "no_such_query", "x", "y"]) == 2


def test_central_meridian(spark):
    from pyspark.sql import functions as F

    x, y = projection.to_plane(F.lit(-105.0), F.lit(40.0), 32613)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 500_000) < 1e-6 and abs(row.y - 4_427_757.2186) < 1e-3  # 0.9996 times the arc of the meridian
    lon, lat = projection.from_plane(F.lit(row.x + 250_000), F.lit(row.y), 32613)
    east, north = projection.to_plane(lon, lat, 32613)
    row2 = spark.range(1).select(east.alias("x"), north.alias("y")).first()
    assert abs(row2.x - row.x - 250_000) < 1e-5 and abs(row2.y - row.y) < 1e-5
    with pytest.raises(ValueError):
        projection.zone_of(4326)
