from __future__ import annotations

from pathlib import Path

from quillon.operators.relations import settled
from quillon.sources import files as FS


def test_scratch_tables_are_recorded_and_released(spark):
    before = len(FS.made)
    one, two, three = (settled(spark.range(n)) for n in (1, 2, 3))
    paths = [Path(p.removeprefix("file://")) for p in FS.made[before:]]
    assert len(paths) == 3 and all(p.exists() for p in paths)
    assert FS.release(spark, keep=1, since=before) == 2
    assert [p.exists() for p in paths] == [False, False, True] and three.count() == 3
    assert FS.release(spark, since=before) == 1 and len(FS.made) == before
