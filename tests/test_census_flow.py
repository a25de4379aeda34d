"""The census flow against a level-by-level loop in pandas that restarts from raw rows, and its partitioned write."""

import numpy as np
import pandas as pd
import pytest

from quarry.plans import census_flow as CF

KEYS = ["ENTIDAD", "MUN", "LOC", "AGEB"]


def table(seed=3):
    rng = np.random.default_rng(seed)
    blocks = [(e, f"E{e}", m, f"M{m}", lo, None if (m, lo) == (2, 1) else f"L{lo}", f"{a:04d}", z, float(rng.integers(0, 50)), float(rng.uniform(5, 12)))
              for e in (1, 2, 3) for m in (1, 2) for lo in (1, 2) for a in (1, 2) for z in range(1, int(rng.integers(2, 6)))]
    df = pd.DataFrame(blocks, columns=["ENTIDAD", "NOM_ENT", "MUN", "NOM_MUN", "LOC", "NOM_LOC", "AGEB", "MZA", "pop", "rate"])
    parts = [df]
    for i in range(4):
        t = df.groupby(KEYS[:4 - i], as_index=False).agg({"pop": "sum", "rate": "mean", "NOM_ENT": "first"})
        t["pop"] *= 1 + rng.uniform(0, 0.1, len(t))
        t["rate"] *= 1 + rng.uniform(0, 0.1, len(t))
        t = t[(t.index % 5 != 3)] if i == 0 else t  # some block groups have no total
        if i == 3:
            t = t[t.ENTIDAD != 3]  # and one state
        for c, blank in (("MUN", 0), ("LOC", 0), ("AGEB", "0000")):
            if c not in t:
                t[c] = blank
        parts.append(t.assign(NOM_LOC=CF.TOTAL_NAMES[i], NOM_MUN="Total", MZA=0))
    return pd.concat(parts, ignore_index=True)[df.columns]


def loop(df, ratio):
    block = (df.MZA != 0) & (df.AGEB != "0000") & (df.LOC != 0) & (df.MUN != 0)
    raw, cur = df[block].copy(), df[block].copy()
    for i in range(4):
        k = KEYS[:4 - i]
        agg = cur.groupby(k)[["pop", "rate"]].agg({"pop": "sum", "rate": "mean"})
        det = df[df.NOM_LOC == CF.TOTAL_NAMES[i]].groupby(k)[["pop", "rate"]].agg({"pop": "sum", "rate": "mean"}).reindex(agg.index)
        f = ((det / agg) if ratio == "direct" else (agg / det)).fillna(1)
        on = pd.MultiIndex.from_frame(raw[k]) if len(k) > 1 else pd.Index(raw[k[0]])
        new = raw[["pop", "rate"]].to_numpy() * f.reindex(on).to_numpy()
        cur = raw.assign(pop=new[:, 0], rate=new[:, 1])
        delta = cur.groupby(k)[["pop", "rate"]].agg({"pop": "sum", "rate": "mean"}) - det
        n = cur.groupby(k)["pop"].size()
        delta["pop"] /= n
        if ratio != "direct":
            delta["rate"] /= n
        shift = delta.reindex(on).to_numpy()
        cur["pop"], cur["rate"] = cur["pop"] - shift[:, 0], cur["rate"] - shift[:, 1]
    return cur


@pytest.mark.parametrize("ratio", ["reference", "direct"])
def test_flow_matches_loop(spark, ratio):
    df = table()
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(),
                                 "ENTIDAD int, NOM_ENT string, MUN int, NOM_MUN string, LOC int, NOM_LOC string, AGEB string, MZA int, pop double, rate double")
    order = [*KEYS, "MZA"]
    got = CF.reconcile_published(rows, ["pop"], ["rate"], ratio).toPandas().sort_values(order)
    want = loop(df, ratio).sort_values(order)
    for m in ("pop", "rate"):
        np.testing.assert_allclose(got[m].astype(float), want[m].astype(float), rtol=1e-9)
        assert got.loc[got.ENTIDAD == 3, m].isna().all()  # no state total
    assert set(got.loc[(got.MUN == 2) & (got.LOC == 1), "NOM_LOC"]) == {"N/A"} and set(got.NOM_ENT) == {"E1", "E2", "E3"}


def test_factors_take_one_scan_and_no_join(spark):
    rows = spark.createDataFrame([], "ENTIDAD int, MUN int, LOC int, NOM_LOC string, AGEB string, MZA int, pop double")
    plan = CF.state_factors(rows, ["pop"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LocalRelation") <= 1
    assert CF.state_factors(rows, ["pop"]).count() == 0


def test_one_write_for_all_states(spark, tmp_path):
    df = table()
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(),
                                 "ENTIDAD int, NOM_ENT string, MUN int, NOM_MUN string, LOC int, NOM_LOC string, AGEB string, MZA int, pop double, rate double")
    out = CF.reconcile_published(rows, ["pop"], ["rate"])
    CF.write_states(out, str(tmp_path / "det"))
    assert sorted(p.name for p in (tmp_path / "det").iterdir() if p.is_dir()) == ["ENTIDAD=1", "ENTIDAD=2", "ENTIDAD=3"]
    assert spark.read.parquet(str(tmp_path / "det")).count() == out.count()
