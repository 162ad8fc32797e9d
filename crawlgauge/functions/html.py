"""Signals read from raw HTML with regular expressions, one page per row.

The expressions follow a lenient HTML tokenizer: comments and script/style
contents are opaque, quoted attribute values may hold any markup, and an
unclosed comment or script runs to the end of the document. Patterns that look
for something also match ordinary tags whole, so that nothing is found inside
their attribute values.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.text import after_first, find_all, matches, present, str_array, strip

# Inside a tag: anything up to '>', except that a quoted value is taken whole.
# Possessive throughout, so the match is linear and needs no stack.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""


def _raw_text(name: str) -> str:
    """A raw-text element: self-closed, closed, or running to the end of input."""
    return (
        rf"{name}(?=[\s/>]){_ATTRS}"
        rf"(?:(?<=/)>|>.*?(?:</{name}(?=[\s/>])[^>]*>|\z))"
    )


# Alternatives share the leading '<', so most positions are rejected by one comparison. An ordinary tag is group 1.
_OPAQUE = rf"(?is)<(?:!--.*?(?:-->|\z)|{_raw_text('script')}|{_raw_text('style')})"
_TOKEN = rf"{_OPAQUE}|(</?[a-z]{_ATTRS}>)"

# Breaks between text runs while markup is being removed.
_CUT = "\x01"
_CUTS = "[\x01-\x03]++"
# An opening body tag becomes \x02\x03, a closing body or html tag \x02/\x03.
_BODY_BOUND = rf"(?i)<(?:body|(/)(?:body|html))(?=[\s/>]){_ATTRS}>"
_FRAME = rf"(?i)<html(?=[\s/>]){_ATTRS}>"
_BODY_OPEN, _BODY_CLOSE = "\x02\x03", "\x02/\x03"


def _not_text(tag: str) -> str:
    """Elements without text, tags that match ``tag``, and declarations."""
    return (
        rf"(?is)<(?:template(?=[\s/>]){_ATTRS}>.*?(?:</template\s*>|\z)"
        rf"|rt(?=[\s/>]){_ATTRS}>.*?(?:</rt\s*>|(?=</ruby)|\z)"
        rf"|rp(?=[\s/>]){_ATTRS}>.*?(?:</rp\s*>|(?=</ruby)|\z)"
        rf"|{tag}{_ATTRS}>|(?!/(?:body|html)[\s/>])[!?/][^>]*>)"
    )


_NOT_TEXT = _not_text("/?[a-z]")
# The frame of the document stays, for its bounds to be read.
_NOT_TEXT_IN_FRAME = _not_text(r"(?!/?(?:body|html)[\s/>])/?[a-z]")

# Element ids of client-side application roots, in order of preference.
CSR_ROOT_IDS = ["root", "app", "__next", "gatsby-focus-wrapper", "nuxt", "__nuxt"]

# Character references decoded without a table lookup, being the usual ones.
_COMMON_ENTITIES = ["nbsp", "quot", "lt", "gt", "copy", "middot"]
# All names of the HTML standard, without the semicolon.
_ENTITY_CHARS = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
# Numeric references 128-159 are read as Windows-1252.
_C1_CHARS = {c: bytes([c]).decode("cp1252", "replace") for c in range(128, 160)}


def _literal_map(values: dict) -> Column:
    """Constant MAP<STRING,STRING>, stated as one literal to keep plan building cheap."""
    pairs = "\x1e".join(f"{k}\x1f{v}" for k, v in values.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))


def _char(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    valid = code.between(2, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return (
        # As in the source itself, the characters that mark cuts are no text.
        F.when(code.between(1, 5), F.lit(""))
        .when(code.between(128, 159), F.try_element_at(_literal_map(_C1_CHARS), code.cast("string")))
        .when(valid, F.decode(utf32, "UTF-32"))
        .otherwise(F.lit("�"))
    )


def _decode_reference(part: Column) -> Column:
    """Decode one text piece that starts right after an ampersand."""
    dec = F.regexp_extract(part, r"^#([0-9]+)", 1)
    hexa = F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    name = F.regexp_extract(part, r"^[a-zA-Z][-.a-zA-Z0-9]*", 0)
    known = F.try_element_at(_literal_map(_ENTITY_CHARS), name)
    # Eight digits are beyond the last character already.
    code = F.when(dec != "", dec.try_cast("bigint")).when(
        F.length(hexa) <= 8, F.conv(hexa, 16, 10).try_cast("bigint")
    )
    return (
        F.when(
            (dec != "") | (hexa != ""),
            F.concat(
                F.coalesce(_char(code), F.lit("�")),
                F.regexp_replace(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""),
            ),
        )
        .when(
            name != "",
            F.concat(
                F.coalesce(known, F.concat(F.lit("&"), name)),
                F.regexp_replace(part, r"^[a-zA-Z][-.a-zA-Z0-9]*;?", ""),
            ),
        )
        .otherwise(F.concat(F.lit("&"), part))
    )


def decode_entities(col: Column) -> Column:
    """Decode character references once (``&amp;copy;`` becomes ``&copy;``)."""
    plain = col
    # The caller's column is read more than once: pass a plain column or lambda field.
    for name in _COMMON_ENTITIES:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(_ENTITY_CHARS[name]))
    # A zero-length match at the start yields no leading empty piece, hence the sentinel.
    pieces = F.split(F.concat(F.lit(_CUT), plain), "&(?=[#a-zA-Z])")
    rest = F.transform(after_first(pieces), _decode_reference)
    general = F.substring(F.concat(F.element_at(pieces, 1), F.array_join(rest, "")), 2, 2**31 - 1)
    only_amp = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(~col.contains("&"), col)
        .when(matches(plain, "&(?!amp;)[#a-zA-Z]"), general)
        .otherwise(only_amp)
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an open tag; the last one if repeated, NULL if absent or bare.

    One walk over the tag: names, separators and values are taken whole, and the
    group keeps what the last value of ``name`` captured.
    """
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)"""
    walk = rf"(?is)^(?:[\s/]++|{name}\s*+=\s*+({value})|[^\s/>=]++|=\s*+{value})*+"
    # Either both ends are quotes or neither is.
    return F.regexp_replace(F.nullif(F.regexp_extract(tag, walk, 1), F.lit("")), "^[\"']|[\"']$", "")


def without_marks(html: Column) -> Column:
    """The source without the control characters that mark cuts below; they are no text of a page."""
    return F.regexp_replace(html, "[\x01-\x05]++", "")


def tokens(html: Column) -> Column:
    """Tags, comments and whole script/style elements, in document order."""
    return find_all(html, _TOKEN)


def named(found: Column, name: str) -> Column:
    """Open tags, or whole elements, of one name."""
    return F.filter(found, lambda t: t.rlike(rf"(?i)^<{name}(?=[\s/>])"))


def script_blocks(found: Column) -> Column:
    return named(found, "script")


def markup_only(html: Column) -> Column:
    """The document with comments, scripts and styles cut out."""
    return F.regexp_replace(html, _TOKEN, f"{_CUT}$1")


def script_open(block: Column) -> Column:
    return F.regexp_extract(block, rf"(?i)^<script{_ATTRS}>", 0)


def script_body(block: Column) -> Column:
    inner = F.regexp_replace(block, rf"(?i)^<script{_ATTRS}>", "")
    return F.regexp_replace(inner, r"(?i)</script(?=[\s/>])[^>]*>$", "")


def script_srcs(scripts: Column) -> Column:
    """Lower-cased src values of the scripts that have one."""
    with_src = F.filter(scripts, lambda b: b.rlike(r"(?i)\ssrc\s*="))
    srcs = F.transform(with_src, lambda b: attribute(script_open(b), "src"))
    return F.transform(F.array_compact(srcs), F.lower)


def ld_json(scripts: Column) -> Column:
    """Bodies of scripts whose type is exactly application/ld+json."""
    typed = F.filter(
        scripts,
        lambda b: b.contains("application/ld+json")
        & (F.coalesce(attribute(script_open(b), "type"), F.lit("")) == "application/ld+json"),
    )
    return F.transform(typed, script_body)


def _has_tag(found: Column, name: str, attr: str, value: str) -> Column:
    """Whether a tag has an attribute of exactly this value; the cheap tests come first."""
    return F.exists(
        found,
        lambda t: t.contains(value)
        & t.rlike(rf"(?i)^<{name}(?=[\s/>])")
        & (F.coalesce(attribute(t, attr), F.lit("")) == value),
    )


def has_og_title(found: Column) -> Column:
    return _has_tag(found, "meta", "property", "og:title")


def has_password(found: Column) -> Column:
    return _has_tag(found, "input", "type", "password")


def has_itemprop_price(found: Column) -> Column:
    # Script and style elements are listed with their contents, which are no attributes.
    return _has_tag(found, "(?!script|style)[a-z][^\\s/>]*+", "itemprop", "price")


def div_ids(found: Column) -> Column:
    with_id = F.filter(named(found, "div"), lambda t: t.rlike(r"(?i)\sid\s*="))
    return F.array_compact(F.transform(with_id, lambda t: attribute(t, "id")))


def csr_root(ids: Column) -> Column:
    """First known application-root id present, in list order rather than page order."""
    present = F.filter(str_array(CSR_ROOT_IDS), lambda r: F.array_contains(ids, r))
    return F.try_element_at(present, F.lit(1))


def bare_text(markup: Column) -> Column:
    """Undecoded text with control characters where markup stood and where the body starts and ends."""
    framed = F.regexp_replace(markup, _NOT_TEXT_IN_FRAME, _CUT)
    bounded = F.regexp_replace(framed, _BODY_BOUND, "\x02$1\x03")
    return F.regexp_replace(bounded, _FRAME, _CUT)


def body_part(cut: Column) -> Column:
    """Text inside the body element, or the whole document if it has none."""
    after = F.substring(cut, F.locate(_BODY_OPEN, cut) + 2, F.char_length(cut))
    inside = F.substring_index(after, _BODY_CLOSE, 1)
    return F.when(cut.contains(_BODY_OPEN), inside).otherwise(cut)


def whole_part(cut: Column) -> Column:
    """Text of the whole document, the marks of closing tags made plain cuts."""
    return F.replace(cut, F.lit(_BODY_CLOSE), F.lit(_CUT))


def text_joined(cut: Column) -> Column:
    """Non-empty stripped text runs joined by one space."""
    runs = F.transform(F.split(cut, _CUTS), strip)
    return F.array_join(F.filter(runs, lambda r: r != ""), " ")


def text_concat(cut: Column) -> Column:
    """All text runs with nothing in between; a blank run shrinks to one newline or space."""
    blank = "[ \t\n\r\f\x0b]"

    def shrink(run: Column) -> Column:
        filler = F.when(run.contains("\n"), F.lit("\n")).otherwise(F.lit(" "))
        return F.when(matches(run, rf"^{blank}++\z"), filler).otherwise(run)

    runs = F.split(cut, _CUTS)
    return F.array_join(F.transform(runs, shrink), "")


_MARK, _MARK_END = "\x04", "\x05"
_LINK = rf"(?i)(<(?!a[\s/>])/?[a-z]{_ATTRS}>)|<a(?=[\s/>])({_ATTRS})>"


def anchors(markup: Column) -> Column:
    """Links in document order: (pos, text, href); text lower-cased, runs fused.

    Each ``transform`` binds what the next one reads more than once.
    """
    # Every tag is kept and followed by marks; between the marks are the attributes if it opens a link.
    marked = F.regexp_replace(markup, _LINK, f"$1{_MARK}$2{_MARK_END}")
    pieces = after_first(F.split(F.replace(marked, F.lit(_MARK + _MARK_END), F.lit("")), _MARK))
    split_up = F.transform(
        pieces,
        lambda p, i: F.struct(
            i.alias("pos"),
            attribute(F.substring_index(p, _MARK_END, 1), "href").alias("href"),
            F.regexp_extract(p, rf"(?is){_MARK_END}(.*?)(?:</a(?=[\s/>])|\z)", 1).alias("inner"),
        ),
    )
    links = F.filter(split_up, lambda a: a["href"].isNotNull())
    bare = F.transform(
        links,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["href"].alias("href"),
            F.when(a["inner"].contains("<"), F.regexp_replace(a["inner"], _NOT_TEXT, _CUT))
            .otherwise(a["inner"])
            .alias("inner"),
        ),
    )

    def fused(inner: Column) -> Column:
        runs = F.split(decode_entities(inner), _CUT)
        whole = strip(decode_entities(inner))
        return F.when(
            inner.contains(_CUT), F.array_join(F.transform(runs, strip), "")
        ).otherwise(whole)

    return F.transform(
        bare,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            F.lower(fused(a["inner"])).alias("text"),
            strip(decode_entities(a["href"])).alias("href"),
        ),
    )


# Element ids left in a page by consent managers.
CONSENT_ELEMENT_IDS = [
    "onetrust-consent-sdk", "cybotcookiebotdialog", "trustarc-consent-manager",
    "didomi-host", "uc-main-dialog",
]


def consent_elements(html_lower: Column) -> Column:
    """Consent-manager element ids occurring anywhere in the lower-cased source."""
    return present([(html_lower.contains(e), e) for e in CONSENT_ELEMENT_IDS])


def with_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the HTML signal columns to ``pages`` and drop the HTML itself.

    Each ``select`` level is read more than once by the next, which keeps the
    optimizer from folding the levels together and evaluating a regex twice.
    """
    keep = [c for c in pages.columns if c != html]
    source = F.col("_source")
    parsed = pages.select(*keep, without_marks(F.col(html)).alias("_source")).select(
        *keep,
        tokens(source).alias("_tokens"),
        markup_only(source).alias("_markup"),
        F.lower(source).alias("_lower"),
    )
    found, markup, scripts = F.col("_tokens"), F.col("_markup"), F.col("_scripts")
    parsed = parsed.select("*", script_blocks(found).alias("_scripts"))
    parts = parsed.select(
        *keep,
        consent_elements(F.col("_lower")).alias("consent_elements"),
        F.size(scripts).alias("script_count"),
        script_srcs(scripts).alias("script_srcs"),
        ld_json(scripts).alias("ld_json"),
        has_og_title(found).alias("has_og_title"),
        has_itemprop_price(found).alias("has_itemprop_price"),
        has_password(found).alias("has_password"),
        div_ids(found).alias("div_ids"),
        anchors(markup).alias("anchors"),
        bare_text(markup).alias("_bare"),
    )
    others = [c for c in parts.columns if c != "_bare"]
    decoded = parts.select(*others, decode_entities(F.col("_bare")).alias("_cut"))
    cut = F.col("_cut")
    return decoded.select(
        *others,
        csr_root(F.col("div_ids")).alias("csr_root"),
        text_joined(whole_part(body_part(cut))).alias("text_body_joined"),
        text_joined(whole_part(cut)).alias("text_all_joined"),
        text_concat(whole_part(cut)).alias("text_all_concat"),
    )
