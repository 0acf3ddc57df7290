"""Parts and canonical form of URLs, as native columns and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, ASCII lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without a default port, path without closing slashes, query without utm_ parameters; null without ://.

    The scheme and the fragment go. http and https addresses of one page are thus one.
    """
    query = F.regexp_replace(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    plain = F.concat(F.regexp_replace(host(url), ":(80|443)$", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.when(query == "", plain).otherwise(F.concat(plain, F.lit("?"), query)))


HOST_SQL = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH_SQL = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
QUERY_SQL = r"regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '')"
PLAIN_SQL = f"concat(regexp_replace({HOST_SQL}, ':(80|443)$', ''), regexp_replace({PATH_SQL}, '/+$', ''))"
CANONICAL_SQL = f"CASE WHEN position('://' IN url) > 0 THEN CASE WHEN {QUERY_SQL} = '' THEN {PLAIN_SQL} ELSE concat({PLAIN_SQL}, '?', {QUERY_SQL}) END END"
