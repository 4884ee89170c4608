"""feedloom: Spark DataFrame operators for landed social-content data.

Raw JSON responses and HTML pages go in; clean content, comment, creator,
contact-edge and activity tables, capped and de-duplicated, come out.
"""

import sys

from pyspark import cloudpickle

# Python workers get our small pandas helpers by value, so executors do not
# need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from feedloom.session import configure  # noqa: E402

__all__ = ["configure"]
