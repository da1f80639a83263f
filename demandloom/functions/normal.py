"""Standard normal distribution and its inverse as column arithmetic.

Spark has neither; both follow published double-precision rational approximations:
Hart's (as given by West, 2005) for the distribution, Wichura's AS 241 for the inverse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximations, highest power first.
CDF_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
]
CDF_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
]
CENTRE_NUMERATOR = [
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
    1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
]
CENTRE_DENOMINATOR = [
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
    5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
]
MIDDLE_NUMERATOR = [
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
    3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
]
MIDDLE_DENOMINATOR = [
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
]
TAIL_NUMERATOR = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
]
TAIL_DENOMINATOR = [
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
]


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    result = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        result = result * x + coefficient
    return result


def normal_cdf(x: Column) -> Column:
    size = F.abs(x)
    density = F.exp(-size * size / 2)
    near = density * polynomial(size, CDF_NUMERATOR) / polynomial(size, CDF_DENOMINATOR)
    fraction = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = size + k / fraction
    far = density / fraction / 2.506628274631
    upper = F.when(size > 37, 0.0).when(size < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def normal_inverse(p: Column) -> Column:
    """Quantile for 0 < p < 1, null outside."""
    q = p - 0.5
    central = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = tail - 1.6
    far = tail - 5.0
    outer = F.when(
        tail <= 5, polynomial(middle, MIDDLE_NUMERATOR) / polynomial(middle, MIDDLE_DENOMINATOR)
    ).otherwise(polynomial(far, TAIL_NUMERATOR) / polynomial(far, TAIL_DENOMINATOR))
    inner = q * polynomial(central, CENTRE_NUMERATOR) / polynomial(central, CENTRE_DENOMINATOR)
    valid = (p > 0) & (p < 1)
    return F.when(valid, F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * outer))
