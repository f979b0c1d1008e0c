"""Web pages: readable text, page facts, url policy and address classes."""

from __future__ import annotations

import ipaddress
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- fixed values ------------------------------------------------------------

HIDDEN = frozenset("script style noscript svg canvas".split())
BLOCKS = frozenset("p div section article main header footer li br h1 h2 h3 h4 h5 h6".split())
CLIP = {"description": 600, "og:title": 240, "og:description": 600}
PORTS = (80, 443)
MAX_URL = 2048


class _Reader(HTMLParser):
    """Collects visible text, the title and the first of each meta fact."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.titling, self.seen, self.title, self.meta = 0, False, [], [], {}

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.titling |= tag == "title"
        if tag == "meta":
            a = {k.lower(): v or "" for k, v in attrs}
            content = a.get("content", "").strip()
            name = "description" if a.get("name", "").lower() == "description" else a.get("property", "").lower()
            if content and name in CLIP:
                self.meta.setdefault(name, content[: CLIP[name]])
        elif tag in BLOCKS:
            self.seen.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "title":
            self.titling = False
        if tag in BLOCKS:
            self.seen.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.seen.append(data)
            if self.titling:
                self.title.append(data)


def read_html(html: str | None) -> dict:
    """Title, text and meta facts of a page; never raises."""
    r = _Reader()
    try:
        r.feed(html or "")
        r.close()
    except (AssertionError, ValueError):  # what was read so far counts
        pass
    clean = lambda parts: re.sub(r"\s+", " ", " ".join(parts)).strip()
    return {"title": clean(r.title) or None, "text": clean(r.seen), "meta_description": r.meta.get("description"), "og_title": r.meta.get("og:title"), "og_description": r.meta.get("og:description")}


SCHEMA = "title string, text string, meta_description string, og_title string, og_description string"


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with title, text, meta facts, content hash and byte count.

    Parsing is a state machine, so it runs over Arrow batches; facts that
    aren't in the text already are put before it.
    """
    import pandas as pd

    def read(s):
        return pd.DataFrame([read_html(x) for x in s], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    read.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    out = pages.withColumn("_page", F.pandas_udf(read, SCHEMA)(F.col(html_col)))
    text = F.col("_page.text")
    for fact in ("meta_description", "og_description", "og_title"):
        extra = F.col(f"_page.{fact}")
        text = F.when(extra.isNotNull() & ~F.contains(text, extra), F.concat_ws(" ", extra, text)).otherwise(text)
    facts = {f: F.col(f"_page.{f}") for f in ("title", "meta_description", "og_title", "og_description")}
    return out.withColumns({**facts, "page_text": text, "content_sha256": F.sha2(html_col, 256), "byte_count": F.octet_length(html_col).cast("long")}).drop("_page")


def normalized_url(url: Column) -> Column:
    """A url without white space at its ends and with ``https://`` if it has no scheme."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when((u == "") | F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))


def _host(full: Column) -> Column:
    net = F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(net, r"^.*@", ""), r":[^:\]]*$", "")


def url_policy(url: Column) -> Column:
    """Why a url may not be fetched; null if it may."""
    u = F.trim(F.coalesce(url, F.lit("")))
    full = normalized_url(url)
    scheme = F.lower(F.regexp_extract(full, r"^([^:/?#]*)://", 1))
    net = F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)", 1)
    at = net.rlike("@")
    port = F.regexp_extract(net, r":([^:\]]*)$", 1)
    return (
        F.when(u == "", "empty")
        .when(u.rlike(r"[\x00-\x20\x7f\x{80}-\x{A0}\s]"), "space or control character")
        .when(F.contains(u, F.lit("\\")), "backslash")
        .when(F.length(u) > MAX_URL, "too long")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(_host(full) == "", "no host")
        .when(at, "user information")
        .when(net.endswith(":"), "port")
        .when((port != "") & ~port.isin(*map(str, PORTS)), "port")
    )


def ascii_host(host: str | None) -> str | None:
    """A host name in its ASCII (punycode) form; null if it has none."""
    try:
        return host.encode("idna").decode("ascii").lower() if host else None
    except UnicodeError:
        return None


def with_safe_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``refused`` (why a url may not be fetched) and ``safe_url``, the url to fetch.

    The host of ``safe_url`` is lower-case ASCII, so it is the host that was
    judged.  Hosts beyond ASCII alone reach Python.
    """
    import pandas as pd

    def convert(s):
        return s.map(ascii_host, na_action="ignore")

    convert.__annotations__ = {"s": pd.Series, "return": pd.Series}
    full = normalized_url(F.col(url_col))
    host = _host(full)
    odd = host.rlike(r"[^\x00-\x7F]")
    out = df.withColumns({"_full": full, "_host": host, "refused": url_policy(F.col(url_col))})
    out = out.withColumn("_plain", F.when(odd, F.pandas_udf(convert, "string")(F.when(odd, host))).otherwise(F.lower("_host")))
    out = out.withColumn("refused", F.coalesce("refused", F.when(F.col("_plain").isNull(), F.lit("host"))))
    start = F.instr("_full", "://") + 3
    rest = F.substring("_full", start + F.length("_host"), F.length("_full"))
    safe = F.when(F.col("refused").isNull(), F.concat(F.substring("_full", F.lit(1), start - 1), F.col("_plain"), rest))
    return out.withColumn("safe_url", safe).drop("_full", "_host", "_plain")


def address_blocked(address: str | None) -> bool | None:
    """Whether an IP address, or one embedded in it, isn't public."""
    try:
        a = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return None
    inner = [a]
    if a.version == 6:
        teredo = a.teredo[1] if a.teredo else None
        low = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF) if int(a) >> 32 == 0 and int(a) > 1 else None
        inner += [x for x in (a.ipv4_mapped, a.sixtofour, teredo, low) if x is not None]
    return any(x.is_private or x.is_loopback or x.is_link_local or x.is_multicast or x.is_reserved or x.is_unspecified for x in inner)


def with_address_class(df: DataFrame, column: str = "address") -> DataFrame:
    import pandas as pd

    def blocked(s):
        return s.map(address_blocked).astype("boolean")

    blocked.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn("blocked", F.pandas_udf(blocked, "boolean")(F.col(column)))


