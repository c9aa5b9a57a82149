from .kernels import *  # noqa: F401,F403
from .normal import normal_cdf, normal_quantile  # noqa: F401
