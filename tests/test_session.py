"""The shared folder and its stages."""

import os

from pagetable.session import Stage, shared_folder


def test_a_stage_is_kept_until_it_is_cleared(spark):
    kept, gone = Stage(spark, "kept"), Stage(spark, "gone")
    frames = [s.save(spark.range(5), "t") for s in (kept, gone)]
    assert [f.count() for f in frames] == [5, 5]
    assert kept.path("t").startswith(shared_folder(spark))
    gone.clear()
    assert not os.path.exists(gone.path("t")) and frames[0].count() == 5
