"""Small generators for oracle SQL over many columns (UNION ALL unpivots)."""

from __future__ import annotations


def q(name: str) -> str:
    return f'"{name}"'


def unpivot(table: str, cols: list[str], cast: str | None = None, extra: str = "") -> str:
    """``SELECT 'c' AS variable, c AS value [, extra] FROM table UNION ALL ...``"""
    parts = []
    for c in cols:
        val = f"CAST({q(c)} AS {cast})" if cast else q(c)
        parts.append(f"SELECT '{c}' AS variable, {val} AS value{', ' + extra if extra else ''} FROM {table}")
    return "\n  UNION ALL ".join(parts)


def per_column(cols: list[str], template: str) -> str:
    """UNION ALL of ``template`` with ``{c}`` (quoted column) and ``{name}``."""
    return "\n  UNION ALL ".join(template.format(c=q(c), name=c) for c in cols)


def numeric_vc(table: str, cols: list[str], target: str | None = '"default"') -> str:
    """CTEs ``u``, ``vc`` and ``cum`` (running counts by plain windows)."""
    extra = f"{target} AS y" if target else "0 AS y"
    return f""", u AS (
  {unpivot(table, cols, "DOUBLE", extra)}
), vc AS (
  SELECT variable, value, COUNT(*) AS n, SUM(y) AS n1 FROM u
  WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY variable, value
), cum AS (
  SELECT *, SUM(n) OVER w AS cn, SUM(n1) OVER w AS cn1,
         SUM(n) OVER (PARTITION BY variable) AS tn, SUM(n1) OVER (PARTITION BY variable) AS tn1
  FROM vc WINDOW w AS (PARTITION BY variable ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


SEPARATION = """, s AS (
  SELECT variable, MAX(tn) AS big_n, MAX(tn1) AS big_n1,
    MAX(ABS(cn1 / tn1 - (cn - cn1) / (tn - tn1))) AS ks,
    SUM(n1 * (cn - (n - 1) / 2.0)) AS r1,
    SUM(n * (cn - (n - 1) / 2.0) * (cn - (n - 1) / 2.0)) AS rs,
    SUM(n * (n - 1) / 2.0) AS tp,
    SUM(CAST(n AS DOUBLE) * n * n - n) AS tie3
  FROM cum GROUP BY variable
), st AS (
  SELECT variable, big_n, big_n1, ks,
    r1 - big_n1 * (big_n1 + 1) / 2.0 AS u1,
    big_n - big_n1 AS big_n0,
    (r1 / big_n - (big_n + 1) / 2.0 * big_n1 / big_n)
      / SQRT((rs / big_n - ((big_n + 1) / 2.0) * ((big_n + 1) / 2.0)) * (big_n1 / big_n) * (1 - big_n1 / big_n))
      AS rho,
    tp, tie3
  FROM s
), sep AS (
  SELECT *, big_n1 * big_n0 - u1 AS u0,
    (2 * u1 - big_n1 * big_n0) / SQRT((big_n * (big_n - 1) / 2.0 - tp) * big_n1 * big_n0) AS tau
  FROM st
)"""


# ---------------------------------------------------------------------------
# tails by plain quadrature and log-gamma sums (other methods than the engine's)
# ---------------------------------------------------------------------------

def _simpson(f: str, low: str, step: str) -> str:
    """Simpson's rule over 2,000 steps; ``f`` is an expression in ``t``."""
    weight = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"(list_sum(list_transform(range(0, 2001), lambda i: {weight} * "
            + f.replace("{t}", f"({low} + i * {step})") + f")) * {step} / 3)")


def erfc(x: str) -> str:
    upper = lambda z: f"({_simpson('exp(-power({t}, 2))', z, '0.005')} * 2 / sqrt(pi()))"
    return f"(CASE WHEN {x} >= 0 THEN {upper(f'({x})')} ELSE 2 - {upper(f'(-({x}))')} END)"


def two_sided(z: str) -> str:
    return f"LEAST(1.0, {erfc(f'(({z}) / sqrt(2.0))')})"


def chi2_sf(x: str, dof: str) -> str:
    """Upper tail for whole dof: Poisson-like sums with log-gamma terms."""
    h = f"({x} / 2.0)"
    term = lambda half: f"exp((j + {half}) * ln({h}) - {h} - lgamma(j + 1.0 + {half}))"
    total = lambda half: f"COALESCE(list_sum(list_transform(range(0, CAST({dof} AS BIGINT) // 2), lambda j: {term(half)})), 0)"
    return (f"(CASE WHEN {dof} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {dof} % 2 = 0 THEN {total('0.0')} "
            f"ELSE {erfc(f'sqrt({h})')} + {total('0.5')} END)")


def t_two_sided(t: str, n: str) -> str:
    """P(|T_n| > t) by quadrature of the density."""
    density = f"exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0)) / sqrt({n} * pi()) * power(1 + power({{t}}, 2) / {n}, -({n} + 1) / 2.0)"
    return f"(1 - 2 * {_simpson(density, '0', f'({t} / 2000.0)')})"


def critical_values(table: str, upper: float = 0.05) -> str:
    """CTEs ending in ``crit(dof, cv)`` by 60 halvings; needs WITH RECURSIVE."""
    return f""", bis(dof, lo, hi, i) AS (
  SELECT DISTINCT CAST(dof AS DOUBLE), CAST(0 AS DOUBLE), dof + 20 * sqrt(2.0 * dof) + 40, 0 FROM {table} WHERE dof >= 1
  UNION ALL
  SELECT dof, CASE WHEN p > {upper} THEN mid ELSE lo END, CASE WHEN p > {upper} THEN hi ELSE mid END, i + 1
  FROM (SELECT *, {chi2_sf('mid', 'dof')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 60))
), crit AS (SELECT dof, (lo + hi) / 2 AS cv FROM bis WHERE i = 60)"""


def holm(table: str) -> str:
    """CTE ``adj``: ``table`` with Holm's adjustment ``ph`` of ``p``."""
    return f""", ho AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, variable) AS i, COUNT(*) OVER () AS m FROM {table}
), adj AS (SELECT *, LEAST(1.0, MAX((m - i + 1) * p) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                 AS ph FROM ho)"""


STARS = "CASE WHEN ph < 0.001 THEN '***' WHEN ph < 0.01 THEN '**' WHEN ph < 0.05 THEN '*' ELSE 'ns' END"
P_TEXT = """CASE WHEN ph < 0.001 THEN '< 0.001***' WHEN ph < 0.01 THEN printf('%.4f', ph) || '**'
       WHEN ph < 0.05 THEN printf('%.4f', ph) || '*' ELSE printf('%.4f', ph) || ' (ns)' END"""


def effect(v: str) -> str:
    return f"CASE WHEN {v} < 0.1 THEN 'Negligible' WHEN {v} < 0.3 THEN 'Small' WHEN {v} < 0.5 THEN 'Medium' ELSE 'Large' END"


def normal_quantile(p: str) -> str:
    """The rational approximation itself, without the engine's refinement."""
    from ..functions.special import _PPF_A, _PPF_B, _PPF_C, _PPF_D, _PPF_LOW

    def poly(x: str, coefs, last: str = "") -> str:
        out = repr(coefs[0])
        for c in coefs[1:]:
            out = f"({out} * {x} + {c!r})"
        return f"({out} * {x} + {last})" if last else out
    mid, tail = f"power({p} - 0.5, 2)", lambda y: f"sqrt(-2 * ln({y}))"
    side = lambda y: f"({poly(tail(y), _PPF_C)} / {poly(tail(y), _PPF_D, '1.0')})"
    return (f"(CASE WHEN {p} < {_PPF_LOW} THEN {side(p)} WHEN {p} > 1 - {_PPF_LOW} THEN -{side(f'(1 - {p})')} "
            f"ELSE {poly(mid, _PPF_A)} * ({p} - 0.5) / {poly(mid, _PPF_B, '1.0')} END)")


Z_MWU = """(GREATEST(u0, u1) - big_n0 * big_n1 / 2.0 - 0.5)
      / SQRT(big_n0 * big_n1 / 12.0 * ((big_n + 1) - tie3 / (big_n * (big_n - 1))))"""
