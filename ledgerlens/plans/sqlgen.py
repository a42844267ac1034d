"""SQL text helpers for oracle queries (same closed forms as the Spark side)."""

from __future__ import annotations


def k2_pvalue_sql(n: str, g1: str, g2: str) -> str:
    """D'Agostino-Pearson p = exp(-K²/2) from SQL expressions n (double),
    biased skewness g1 and biased excess kurtosis g2."""
    y = f"(CASE WHEN ({g1}) * sqrt((({n}) + 1) * (({n}) + 3) / (6.0 * (({n}) - 2))) = 0 THEN 1.0 ELSE ({g1}) * sqrt((({n}) + 1) * (({n}) + 3) / (6.0 * (({n}) - 2))) END)"
    beta2 = f"(3.0 * (({n})*({n}) + 27*({n}) - 70) * (({n}) + 1) * (({n}) + 3) / ((({n}) - 2) * (({n}) + 5) * (({n}) + 7) * (({n}) + 9)))"
    w2 = f"(sqrt(2.0 * ({beta2} - 1)) - 1)"
    delta = f"(1.0 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    z1 = f"({delta} * asinh({y} / {alpha}))"
    b2 = f"(({g2}) + 3.0)"
    e = f"(3.0 * (({n}) - 1) / (({n}) + 1))"
    var = f"(24.0 * ({n}) * (({n}) - 2) * (({n}) - 3) / ((({n}) + 1) * (({n}) + 1) * (({n}) + 3) * (({n}) + 5)))"
    x = f"(({b2} - {e}) / sqrt({var}))"
    sb1 = f"(6.0 * (({n})*({n}) - 5*({n}) + 2) / ((({n}) + 7) * (({n}) + 9)) * sqrt(6.0 * (({n}) + 3) * (({n}) + 5) / (({n}) * (({n}) - 2) * (({n}) - 3))))"
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1 + 4.0 / ({sb1} * {sb1}))))"
    denom = f"(1 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    term2 = f"(sign({denom}) * cbrt((1 - 2.0 / {a}) / abs({denom})))"
    z2 = f"(((1 - 2.0 / (9.0 * {a})) - {term2}) / sqrt(2.0 / (9.0 * {a})))"
    return f"exp(-(power({z1}, 2) + power({z2}, 2)) / 2.0)"


def chi2_even_sf_sql(x: str, dof: int) -> str:
    """Upper tail of χ² with even dof: exp(-x/2)·Σ_{k<dof/2} (x/2)^k/k!."""
    assert dof % 2 == 0
    h = f"(({x}) / 2.0)"
    terms = " + ".join(f"power({h}, {k}) / {float(_fact(k))}" for k in range(dof // 2))
    return f"(exp(-{h}) * ({terms}))"


def _fact(k: int) -> int:
    out = 1
    for i in range(2, k + 1):
        out *= i
    return out


def f2_sf_sql(f: str, d2: str) -> str:
    """Upper tail of F(2, d2): (1 + 2f/d2)^(-d2/2)."""
    return f"power(1 + 2.0 * ({f}) / ({d2}), -({d2}) / 2.0)"


def digits_sql(v: str) -> str:
    """Digits of printf('%.15g', |v|), non-digits removed, leading zeros stripped."""
    return f"ltrim(regexp_replace(printf('%.15g', abs({v})), '[^0-9]', '', 'g'), '0')"


def valid_sql(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND NOT isinf({v}))"


def _simpson_sql(f, top: str, steps: int = 4000) -> str:
    """Simpson's rule of f(u) from 0 to ``top``; ``f`` gives SQL for an SQL abscissa."""
    at = f"(({top}) * k / {float(steps)})"
    weight = f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({top}) / {3.0 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {f(at)})))"


def t_p2_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t with any dof: 1 less the integral of cos^(dof - 1) up to atan(t / sqrt(dof)),
    over the whole integral. Where the tails are thin, |t| beyond 40 adds nothing."""
    reach = f"atan((CASE WHEN ({dof}) > 100 THEN least(abs({t}), 40.0) ELSE abs({t}) END) / sqrt({dof}))"
    whole = f"(sqrt(pi()) / 2.0 * exp(lgamma(({dof}) / 2.0) - lgamma((({dof}) + 1) / 2.0)))"
    return f"greatest(1 - {_simpson_sql(lambda u: f'power(cos({u}), ({dof}) - 1)', reach)} / {whole}, 0.0)"


def norm_p2_sql(z: str) -> str:
    """Two-sided normal p."""
    inside = _simpson_sql(lambda u: f"exp(-0.5 * {u} * {u})", f"least(abs({z}), 40.0)")
    return f"greatest(1 - 2.0 / sqrt(2 * pi()) * {inside}, 0.0)"


def norm_isf_sql(source: str, p: str, steps: int = 14) -> str:
    """SELECT of ``source`` with zi, the z whose two-sided normal p is column ``p``: Newton steps from 0, which
    approach from below as the tail is convex."""
    sql = f"SELECT *, CAST(0 AS DOUBLE) AS zi FROM {source}"
    for _ in range(steps):
        step = f"({norm_p2_sql('zi')} - {p}) / (2 * exp(-0.5 * zi * zi) / sqrt(2 * pi()))"
        sql = f"SELECT * REPLACE (CASE WHEN {p} IS NULL THEN zi ELSE zi + {step} END AS zi) FROM ({sql})"
    return sql


def chi2_sf_sql(x: str, dof: int) -> str:
    """Upper tail of chi-square with 3 or more dof."""
    scale = f"(lgamma({dof / 2.0}) + {dof / 2.0} * ln(2.0))"
    inside = _simpson_sql(lambda u: f"(CASE WHEN {u} > 0 THEN exp({dof / 2.0 - 1} * ln(greatest({u}, 1e-300)) - {u} / 2 - {scale}) ELSE 0 END)",
                          f"least({x}, {dof + 60 * (2 * dof) ** 0.5})")
    return f"greatest(1 - {inside}, 0.0)"


def f_even_sf_sql(f: str, d1: int, d2: str) -> str:
    """Upper tail of F(d1, d2) with even d1: x^(d2/2) times a sum of d1/2 terms, x = d2 / (d2 + d1 f)."""
    assert d1 % 2 == 0
    x = f"(({d2}) / (({d2}) + {d1} * ({f})))"
    terms, rising = [], "1.0"
    for j in range(d1 // 2):
        terms.append(f"{rising} / {float(_fact(j))} * power(1 - {x}, {j})")
        rising += f" * (({d2}) / 2.0 + {j})"
    return f"(power({x}, ({d2}) / 2.0) * ({' + '.join(terms)}))"


def holm_sql(table: str, p: str = "p_raw") -> str:
    """CTEs s, h over ``table`` (group_a, group_b, p): Holm-adjusted p as p_adj."""
    return f"""s AS (SELECT *, (count(*) OVER () - row_number() OVER w + 1) * {p} AS step, row_number() OVER w AS place
  FROM {table} WINDOW w AS (ORDER BY {p}, group_a, group_b)),
h AS (SELECT *, least(max(step) OVER (ORDER BY place), 1.0) AS p_adj FROM s)"""
