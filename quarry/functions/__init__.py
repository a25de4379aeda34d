from quarry.functions.exprs import (  # noqa: F401
    calendar_features,
    capacity_policy,
    delta_flag,
    erf,
    guarded_ratio,
    haversine,
    ln_pos,
    norm_cdf,
    safe_div,
    seeded_normal,
    seeded_uniform,
    sigmoid,
    step_flag,
    weekday,
)
