"""One form for the addresses of one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track the visitor.
TRACKING = r"^(?:utm_\w+|fbclid|gclid|gclsrc|dclid|msclkid|yclid|mc_cid|mc_eid|igshid|twclid|ttclid|wbraid|gbraid|_ga|_gl|ref|ref_src|referrer|cmpid|icid|ncid|ocid|smid|spm|share|source_id|campaign_id|ito|partner)$"


def canonical_url(url: Column) -> Column:
    """``url`` without what does not choose the page: scheme, case of the host, a www or m prefix, the default
    port, fragment, last slash, order of the parameters, and parameters that only track the visitor.

    Null and blank give null; text that is no address is compared as it stands, trimmed.
    """
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    u = F.regexp_replace(u, r"#.*$", "")
    rest = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^[^@]*@", "")
    host = F.regexp_replace(host, ":(?:80|443)$", "")  # either: the scheme does not count
    host = F.regexp_replace(F.regexp_replace(host, r"\.(?=:|$)", ""), r"^(?:www\d?|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING),
    )
    query = F.array_join(F.array_sort(pairs), "&")
    page = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u != "", page)
