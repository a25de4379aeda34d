"""The header is found in the sheet's first file, whatever the files, blocks and listing."""

import pytest

from quarry.sources.readers import read_two_row_header

LINES = ["ENTIDAD,2020,,2021", ",ENE,FEB,ENE"] + [f"S{i:02d},{i},{i}.5,{100 + i}" for i in range(40)]


@pytest.mark.parametrize("block", ["128m", "16b", "60b"])
@pytest.mark.parametrize("cuts", [(42,), (1, 20, 42), (2, 42), (30, 42)])
def test_header_of_split_sheets(spark, tmp_path, block, cuts):
    at = 0
    for i, cut in enumerate(cuts):
        # later files are larger or smaller than the first, so that listing by size moves them
        (tmp_path / f"part-{i:05d}.csv").write_text("\n".join(LINES[at:cut]) + "\n")
        at = cut
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted(map(tuple, read_two_row_header(spark, str(tmp_path)).collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = sorted((f"S{i:02d}", y, m, v) for i in range(40) for y, m, v in ((2020, "ENE", float(i)), (2020, "FEB", i + 0.5), (2021, "ENE", 100.0 + i)))
    assert got == want
