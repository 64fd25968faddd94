"""Text, URL and HTML expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, CJK characters, ends of sentences.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
CJK, SENTENCE = "([一-鿿])", r"(?<=[。.?!])\s+|\n\n|\n"
#: Where a heading's or paragraph's text ends, closed or not; a mark is put there before matching.
PART_END = r"(?i)(<h[1-6]\b|<p\b|</h[1-6]>|</p>|</article>|</body>)"
PART, PARAGRAPH = r"(?i)<(h[1-6]|p)\b[^>]*>([^\x01]*)", r"(?i)<p\b[^>]*>([^\x01]*)"
#: An anchor's address, in double quotes, single quotes or none.
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
RISKY = ("login", "signup", "account", "captcha", "auth", "cookie")  # fixed values


def words(text: Column) -> Column:
    """Tokens without special ones: CJK characters stand alone, letters and digits run together."""
    spaced = F.regexp_replace(text, CJK, " $1 ")
    return F.coalesce(F.regexp_count(spaced, F.lit(TOKEN)), F.lit(0))


def token_count(text: Column) -> Column:
    """Tokens of a text, two special ones included."""
    return words(text) + 2


def sentences(text: Column) -> Column:
    """Parts of a text after sentence ends and at line ends; only a single line end is
    taken at once, so blank lines give empty parts as they do for two line ends in a row."""
    return F.split(text, SENTENCE, -1)


def extension(name: Column) -> Column:
    """The part after the last dot, lower-cased; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_key(url: Column) -> Column:
    """Host with ``_`` for dots, and the first 50 characters of the path with ``_`` for slashes."""
    return F.concat(F.replace(authority(url), F.lit("."), F.lit("_")), F.replace(F.substring(url_path(url), 1, 50), F.lit("/"), F.lit("_")))


def real_url(url: Column) -> Column:
    """The target of a search engine's redirect: the decoded ``uddg`` parameter, else (also where it can't be decoded) the URL itself."""
    whole = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    asked = F.regexp_extract(whole, r"[?&]uddg=([^&#]*)", 1)
    return F.when(asked != "", F.coalesce(F.try_url_decode(asked), whole)).otherwise(whole)


def risky(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(RISKY)), F.lit(False))


def resolve(href: Column, base: Column) -> Column:
    """``href`` seen from ``base`` as a browser resolves it: absolute, scheme-relative, root-relative, a query or
    fragment of the page itself, or beside the page; ``.`` and ``..`` are taken out of the path. White space around it goes."""
    href = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    root, page = F.concat(scheme, F.lit("://"), authority(base)), F.regexp_extract(base, r"^([^?#]*)", 1)
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(href == "", base)
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )
    return F.when(url_path(whole).rlike(r"/\.\.?(/|$)"), without_dots(whole)).otherwise(whole)


def without_dots(url: Column) -> Column:
    """``url`` with ``.`` and ``..`` taken out of its path; ``..`` at the root goes."""
    parts = F.split(url_path(url), "/")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    # A path that ends in . or .. names a folder.
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), tail, F.regexp_extract(url, r"^[^?#]*(.*)$", 1))


def without_code(html: Column) -> Column:
    """HTML without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")


def marked(html: Column) -> Column:
    return F.regexp_replace(without_code(html), PART_END, "\x01$1")


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Text of an HTML part: tags out, entities back, white space put together."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def frames(text: Column, size: int = 80) -> Column:
    """Pieces of ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
