"""URL expressions (JVM-side)."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

# Names of tracking parameters besides all that start with utm_.
TRACKING = ["_hsenc", "_hsmi", "dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "oly_anon_id", "oly_enc_id", "rb_clickid", "s_cid", "vero_conv", "vero_id"]

_URL = "^(?i)(https?)://(?:[^/?#@]*@)?(\\[[0-9a-f:.]+\\]|[^/?#:@\\[\\]\\s]+)(?::(\\d{0,5}))?(/[^?#]*)?(?:\\?([^#]*))?(?:#.*)?$"


def is_tracking(name: Column) -> Column:
    n = F.lower(strip(name))
    return n.startswith("utm_") | n.isin(TRACKING)


def url_parts(url: Column) -> Column:
    """``array(scheme, host, port, path, query)`` of an http(s) URL, else null."""
    u = strip(url)
    return F.when(u.rlike(_URL), F.split(F.regexp_replace(u, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", -1))


def query_items(query: Column) -> Column:
    """The items of a query that aren't tracking, ordered by (lower key, key, value)."""
    items = F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~is_tracking(F.substring_index(x, "=", 1)))
    pairs = F.transform(items, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("l"), F.substring_index(x, "=", 1).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])


def canonical_url(url: Column) -> Column:
    """One spelling per http(s) URL, else null.

    Scheme and host in lower case, no user, default port, fragment or
    trailing slash, no tracking parameters, the other parameters in order.
    Percent-encoding is left as it is.
    """
    # The lambda binds the parts once; as a plain expression the match would be copied into each use.
    return F.transform(F.array(url_parts(url)), _respelled)[0]


def _respelled(p: Column) -> Column:
    scheme, host, port = F.lower(p[0]), F.regexp_replace(F.lower(p[1]), "\\.+$", ""), p[2]
    number = F.when(port == "", F.lit(-1)).otherwise(port.try_cast("int"))
    default = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    path = F.regexp_replace(F.when(p[3] == "", "/").otherwise(p[3]), "(?<=.)/+$", "")
    path = F.when(path.rlike("^/+$"), "/").otherwise(path)
    query = F.array_join(query_items(p[4]), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((host != "") & (number <= 65535), made)


def page_key(url: Column) -> Column:
    """Names the page a URL leads to: as ``canonical_url``, and alike for http and https, www. and mobile hosts, index files and escapes."""
    c = canonical_url(url)
    c = F.regexp_replace(c, "^https?://(?:(?:www\\d?|m|mobile|amp)\\.)*", "")
    c = F.regexp_replace(c, "/(?:index|default)\\.(?:html?|php)(?=\\?|$)|/(?=\\?|$)", "")
    return F.coalesce(F.try_url_decode(c), c)


def is_http_url(c: Column) -> Column:
    """An absolute http(s) URL with a host."""
    return F.coalesce(strip(c).rlike("^(?i)https?://[^/?#\\s]+"), F.lit(False))


def origin(c: Column) -> Column:
    """``scheme://host/`` of an http(s) URL, else null."""
    return F.when(is_http_url(c), F.concat(F.regexp_extract(strip(c), "^([^/]+//[^/?#]+)", 1), F.lit("/")))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as an absolute URL; the link itself where there is no base, null for a null link."""
    return pd.Series([None if x is None else urljoin(b or "", x.strip()) for b, x in zip(base, link, strict=True)], dtype=object)
