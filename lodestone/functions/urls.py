"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# Query parameters that only track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name fbclid gclid gclsrc dclid msclkid mc_cid mc_eid igshid yclid ref ref_src ref_url _ga _gl spm si feature ocid cmpid source".split()
# Parameters that ask for an AMP page.
AMP = "amp amp=1 amp=true output=amp outputtype=amp".split()
# Second levels under which two-letter domains register.
SECOND_LEVELS = "co com org net gov edu ac or ne".split()
# File endings of binary content.
BINARY = "zip tar gz tgz bz2 xz 7z rar exe dmg pkg msi deb rpm iso bin png jpg jpeg gif webp svg ico bmp tiff mp3 wav ogg flac mp4 webm avi mov mkv woff woff2 ttf otf eot".split()


def part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def host_of(url: Column) -> Column:
    """Lower-case host, or an empty string."""
    return F.lower(part(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def registrable_domain(host: Column) -> Column:
    """Last two labels; three under a two-letter domain's usual second levels."""
    labels = F.filter(F.split(F.lower(host), "\\."), lambda x: x != "")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(SECOND_LEVELS)
    return F.when(n <= 2, F.array_join(labels, ".")).when(deep, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def matches_domain(host: Column, patterns: list[str]) -> Column:
    """host is one of the domains or lies under one."""
    names = [p.lower().removeprefix("*").lstrip(".") for p in patterns]
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return out


def normalize_url(url: Column) -> Column:
    """http(s) URLs, cleaned; others are null."""
    return let(clean_url(url), lambda u: F.when(u.rlike("(?i)^https?://[^/?#]+"), u))


def canonical_url(url: Column) -> Column:
    """The cleaned URL; host lower and without www, default port, tracking and AMP parameters and a final slash off, parameters in order of their keys."""

    def of(bare: Column) -> Column:
        scheme = F.lower(part(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://"))
        host = F.regexp_replace(host_of(bare), "^www\\.", "")
        port = part(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)")
        keep_port = (port != "") & ~(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")))
        path = part(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
        path = F.when(path == "", "/").when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
        kept = F.filter(F.split(part(bare, "\\?(.*)$"), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(TRACKING) & ~F.lower(p).isin(AMP))
        # stable: parameters of one key stay in their order
        ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p"))))
        text = F.array_join(F.transform(ordered, lambda x: x["p"]), "&")
        whole = F.concat(scheme, F.lit("://"), host, F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
        return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise(url)

    return let(clean_url(url), of)


# Redirect wrappers and the parameter that holds the target.
WRAPPERS = (
    ("^https?://(?:www\\.)?google\\.[a-z.]+/url\\?", "q|url"), ("^https?://lm?\\.facebook\\.com/l\\.php\\?", "u"), ("^https?://l\\.instagram\\.com/[^?]*\\?", "u"),
    ("^https?://(?:www\\.)?duckduckgo\\.com/l/?\\?", "uddg"), ("^https?://(?:www\\.|m\\.)?youtube\\.com/redirect\\?", "q"),
    ("^https?://(?:www\\.)?linkedin\\.com/redir/redirect\\?", "url"), ("^https?://slack-redir\\.net/link\\?", "url"),
)
# Rewrites of AMP and mobile forms, in order.
FOLDS = (
    ("#.*$", ""), ("^https?://[^/?]+\\.cdn\\.ampproject\\.org/[a-z]/s/", "https://"), ("^https?://[^/?]+\\.cdn\\.ampproject\\.org/[a-z]/", "http://"),
    ("^https?://(?:www\\.)?google\\.[a-z.]+/amp/s/", "https://"), ("^(https?://)amp\\.", "$1"), ("(?:/amp/?|\\.amp)(\\?.*)?$", "$1"),
    ("^(https?://[a-z-]+)\\.m\\.(wikipedia|wiktionary|wikibooks|wikiquote|wikisource|wikinews|wikiversity|wikivoyage|wikimedia)\\.org", "$1.$2.org"),
)


def unwrap_redirect(url: Column) -> Column:
    """The target of a known redirect wrapper, decoded; else the URL."""

    def of(u: Column) -> Column:
        found = F.coalesce(*[F.when(u.rlike(pattern), F.try_url_decode(part(u, f"[?&](?:{names})=([^&#]+)"))) for pattern, names in WRAPPERS])
        return let(found, lambda target: F.when(target.rlike("^https?://"), target).otherwise(u))

    return let(url, of)


def clean_url(url: Column, depth: int = 3) -> Column:
    """Redirect wrappers unwrapped, AMP and mobile forms folded, fragment off."""
    out = url
    for _ in range(depth):
        out = unwrap_redirect(out)
    for pattern, new in FOLDS:
        out = F.regexp_replace(out, pattern, new)
    return out


def text_fragment(url: Column) -> Column:
    """Decoded #:~:text= directives, joined by an ellipsis; null without."""
    found = F.regexp_extract_all(F.regexp_extract(url, ":~:(.*)$", 1), F.lit("text=([^&]*)"), F.lit(1))
    plain = F.transform(found, lambda x: F.array_join(F.transform(F.filter(F.split(x, ","), lambda p: ~p.endswith("-") & ~p.startswith("-")), lambda p: F.try_url_decode(p)), " … "))
    return F.when(F.size(found) > 0, F.substring(F.array_join(plain, " … "), 1, 500))


def looks_binary(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "[?#].*$", "")).rlike(f"\\.({'|'.join(BINARY)})$")


def page_url(url: Column, page: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#page="), page.cast("string"))).otherwise(url)


def public_host(host: Column) -> Column:
    """Whether a host may be fetched: no private, loopback, link-local, shared, multicast or reserved address, no local name."""
    low = F.lower(F.regexp_replace(host, "^\\[|\\]$", ""))
    v4 = F.coalesce(F.nullif(F.regexp_extract(low, "^(?:::ffff:)?([0-9]{1,3}(?:\\.[0-9]{1,3}){3})$", 1), F.lit("")), F.lit(""))
    o = F.transform(F.split(v4, "\\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b, c = F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.get(o, F.lit(2))
    closed = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = low.contains(":") & (v4 == "") & (low.rlike("^(?:::1?$|f[cd]|fe[89ab]|ff)"))
    name = low.rlike("^(?:localhost|.*\\.(?:localhost|local|internal|home\\.arpa))\\.?$") | (low == "")
    return ~F.coalesce(F.when(v4 != "", closed).otherwise(v6 | name), F.lit(True))


def is_primary_for(url: Column, query: Column) -> Column:
    """The label of the URL's domain (three letters at least) is a word of the query, or holds one of four letters or more."""
    label = F.element_at(F.split(registrable_domain(host_of(url)), "\\."), 1)
    words = F.filter(F.split(F.lower(query), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return let(label, lambda x: (F.length(x) >= 3) & F.exists(words, lambda w: (w == x) | ((F.length(w) >= 4) & F.contains(x, w))))


def text_fragment_url(url: Column, text: Column) -> Column:
    """url#:~:text=... from the words of a passage: all of up to ten, else the first and last five; the URL itself for fewer than three."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]*\\)", " "), "\\[([^\\]]+)\\]\\([^)]*\\)", "$1"), "[#*_>|`~\\[\\]]", " ")

    def code(words: Column) -> Column:
        return F.replace(F.replace(F.url_encode(F.array_join(words, " ")), F.lit("+"), F.lit("%20")), F.lit("-"), F.lit("%2D"))

    def of(w: Column) -> Column:
        bare = F.regexp_replace(url, "#.*$", "")
        short = F.concat(bare, F.lit("#:~:text="), code(w))
        long = F.concat(bare, F.lit("#:~:text="), code(F.slice(w, 1, 5)), F.lit(","), code(F.slice(w, -5, 5)))
        return F.when(F.size(w) < 3, url).when(F.size(w) <= 10, short).otherwise(long)

    return let(F.filter(F.split(plain, "[ \\t-\\r]+"), lambda w: w != ""), of)
