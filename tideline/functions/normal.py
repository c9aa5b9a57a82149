"""Standard normal distribution as Column arithmetic (Spark has no erf).

The coefficients are the published double-precision rational approximations of
Hart (1968, as arranged by West 2005) for the CDF and of Wichura (1988, AS 241)
for the quantile. They are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
Q_CENTRE_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
                1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
Q_CENTRE_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
                5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
Q_MID_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
             3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
Q_MID_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
             6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
Q_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
              2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
Q_TAIL_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
              1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def _horner(x: Column, coefficients) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; keeps the expression tree small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cdf(z: Column) -> Column:
    a = F.abs(z)
    bell = F.exp(-(a * a) / 2.0)
    near = bell * _horner(a, CDF_NUM) / _horner(a, CDF_DEN)
    far = bell / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def _outer(r: Column) -> Column:
    mid = _let(r - 1.6, lambda x: _horner(x, Q_MID_NUM) / _horner(x, Q_MID_DEN))
    tail = _let(r - 5.0, lambda x: _horner(x, Q_TAIL_NUM) / _horner(x, Q_TAIL_DEN))
    return F.when(r <= 5.0, mid).otherwise(tail)


def _quantile(p: Column) -> Column:
    q = p - 0.5
    centre = q * _let(0.180625 - q * q, lambda x: _horner(x, Q_CENTRE_NUM) / _horner(x, Q_CENTRE_DEN))
    outer = _let(F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p))), _outer)
    value = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -outer).otherwise(outer)
    return F.when((p > 0) & (p < 1), value)


def normal_cdf(z: Column) -> Column:
    return _let(z, _cdf)


def normal_quantile(p: Column) -> Column:
    return _let(p, _quantile)


def _sql_horner(x: str, coefficients) -> str:
    value = repr(coefficients[0])
    for c in coefficients[1:]:
        value = f"({value}*{x}+{c!r})"
    return value


def sql_normal_cdf(z: str) -> str:
    """The same arithmetic as SQL text, for checking against another engine."""
    a = f"abs({z})"
    bell = f"exp(-({a}*{a})/2.0)"
    near = f"{bell}*{_sql_horner(a, CDF_NUM)}/{_sql_horner(a, CDF_DEN)}"
    far = f"{bell}/({a}+1.0/({a}+2.0/({a}+3.0/({a}+4.0/({a}+0.65)))))/2.506628274631"
    tail = f"(case when {a}>37.0 then 0.0 when {a}<7.07106781186547 then {near} else {far} end)"
    return f"(case when {z}>0 then 1.0-{tail} else {tail} end)"


def sql_normal_quantile(p: str) -> str:
    q = f"({p}-0.5)"
    r0 = f"(0.180625-{q}*{q})"
    r = f"sqrt(-ln(case when {q}<0 then {p} else 1.0-{p} end))"
    centre = f"{q}*{_sql_horner(r0, Q_CENTRE_NUM)}/{_sql_horner(r0, Q_CENTRE_DEN)}"
    mid = f"{_sql_horner(f'({r}-1.6)', Q_MID_NUM)}/{_sql_horner(f'({r}-1.6)', Q_MID_DEN)}"
    tail = f"{_sql_horner(f'({r}-5.0)', Q_TAIL_NUM)}/{_sql_horner(f'({r}-5.0)', Q_TAIL_DEN)}"
    outer = f"(case when {r}<=5.0 then {mid} else {tail} end)"
    return f"(case when abs({q})<=0.425 then {centre} when {q}<0 then -{outer} else {outer} end)"
