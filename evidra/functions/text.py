"""Text and URL functions as Column expressions; all stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys whose values are secret, hosts of discussion threads, redirect hosts and their target
#: key, the path of a thread, how much of a reason is kept, and what pages and errors say.
SECRET_KEYS = ("solution", "js_challenge", "token", "jsc_orig_r")
THREAD_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com")
REDIRECT_HOST, REDIRECT_KEY = "duckduckgo.com", "uddg"
THREAD_PATH = r"(?i)^/(?:r/([^/]+)/)?comments/([a-z0-9]+)(?:/([^/?#]+))?/?$"
KEPT_REASON_CHARS = 500
UNAVAILABLE_TEXT = r"(?i)timeout|timed out|network error|ERR_|ECONN|ENOTFOUND|EAI_AGAIN"
UNPARSED_TEXT = r"(?i)JSON|parse|root post|two-listing array"
CHALLENGE_TEXT = r"(?i)unusual traffic|bot challenge|verify (?:you are|that you are) human|duckduckgo.*anomaly|whoa there, pardner|you(?:'ve| have) been blocked"


def redact(c: Column, keep: int = KEPT_REASON_CHARS) -> Column:
    """Secret query values and home folders masked, then cut to ``keep`` characters."""
    keys = "|".join(SECRET_KEYS)
    masked = F.regexp_replace(c, rf"(?i)((?:{keys})=)[^&\s:]*", "$1<redacted>")
    return F.substring(F.regexp_replace(masked, r"/home/[^/\s:]+", "~"), 1, keep)


def without_secret_params(url: Column) -> Column:
    """The URL without secret query parameters; the others keep their order."""
    keys = "|".join(SECRET_KEYS)
    bare = F.regexp_replace(url, rf"(?<=[?&])(?:{keys})=[^&#]*(?:&|(?=#|$))", "")
    return F.regexp_replace(bare, r"[?&](?=#|$)", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clip(c: Column, n: int) -> Column:
    """At most n characters, the last being an ellipsis where something was cut."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def safe_name(c: Column, fallback: str = "attempt", keep: int = 80) -> Column:
    """Letters, digits, dash and underscore; other runs become a dash, none at the edges."""
    dashed = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(text_or_null(F.substring(dashed, 1, keep)), F.lit(fallback))


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def thread_url(c: Column, hosts: tuple[str, ...] = THREAD_HOSTS, base: str = "https://www.reddit.com") -> Column:
    """STRUCT<url, post_id, external_id, subreddit> of a discussion thread's URL in its canonical form, redirects unwrapped.

    Null for anything that is no thread URL of the allowed hosts.
    """
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    wrapped = (host == REDIRECT_HOST) | host.endswith("." + REDIRECT_HOST)
    target = F.when(wrapped, F.try_url_decode(F.try_parse_url(c, F.lit("QUERY"), F.lit(REDIRECT_KEY)))).otherwise(c)
    path = F.regexp_replace(F.try_parse_url(target, F.lit("PATH")), r"(?i)\.json/?$", "")
    known = F.lower(F.try_parse_url(target, F.lit("HOST"))).isin(*hosts) & F.lower(F.try_parse_url(target, F.lit("PROTOCOL"))).isin("http", "https")
    subreddit = text_or_null(F.regexp_extract(path, THREAD_PATH, 1))
    post = F.lower(F.regexp_extract(path, THREAD_PATH, 2))
    slug = F.coalesce(text_or_null(F.regexp_extract(path, THREAD_PATH, 3)), F.lit("_"))
    url = F.concat(F.lit(base), F.coalesce(F.concat(F.lit("/r/"), subreddit), F.lit("")), F.lit("/comments/"), post, F.lit("/"), slug, F.lit("/"))
    return F.when(known & path.rlike(THREAD_PATH), F.struct(url.alias("url"), post.alias("post_id"), F.concat(F.lit("t3_"), post).alias("external_id"), subreddit.alias("subreddit")))


def thread_json_url(canonical: Column, limit: int = 500, sort: str = "confidence") -> Column:
    return F.concat(F.regexp_replace(canonical, "/$", ""), F.lit(f".json?limit={limit}&raw_json=1&sort={sort}"))


def search_url(base: str, query: Column, subreddits: Column, site: str = "www.reddit.com") -> Column:
    """A search within the site, within one subreddit if there is exactly one."""
    scope = F.when(F.size(subreddits) == 1, F.concat(F.lit(f"site:{site}/r/"), subreddits[0])).otherwise(F.lit(f"site:{site}"))
    return F.concat(F.lit(base + "?q="), F.url_encode(F.concat_ws(" ", scope, query)))


def access_class(status: Column, url: Column, title: Column, text: Column) -> Column:
    """Why a page could not be read, by the first rule that holds; null for a readable page."""
    shown = F.substring(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), 1, 8000)
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    challenged = query.rlike("(?:^|&)(?:" + "|".join(SECRET_KEYS) + ")=")
    return (
        F.when(status == 429, "rate_limited").when(status == 401, "auth_required").when(status == 403, "forbidden")
        .when((status == 202) & F.lower(F.try_parse_url(url, F.lit("HOST"))).endswith(REDIRECT_HOST), "blocked")
        .when(challenged | shown.rlike(CHALLENGE_TEXT), "blocked")
    )


def error_class(message: Column) -> Column:
    return F.when(message.rlike(UNAVAILABLE_TEXT), "upstream_unavailable").when(message.rlike(UNPARSED_TEXT), "parse_failed").otherwise("failed")


def lines(c: Column) -> Column:
    """The lines of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def artifact_name_ok(c: Column, most_bytes: int = 255) -> Column:
    """A relative path without backslashes, empty parts or dots as parts."""
    return F.coalesce(c.rlike(r"^[^/\\\x00]+(?:/[^/\\\x00]+)*$") & ~c.rlike(r"(?:^|/)\.{1,2}(?:/|$)") & (F.octet_length(c) <= most_bytes), F.lit(False))


#: Media types by file ending.
MEDIA_TYPES = {"json": "application/json", "html": "text/html", "txt": "text/plain", "csv": "text/csv", "png": "image/png", "pdf": "application/pdf"}


def media_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(kinds[ending], F.lit("application/octet-stream"))


def bytes_label(c: Column) -> Column:
    return F.when(c.isNull(), "—").when(c < 1024, F.format_string("%d B", c)).when(c < 1048576, F.format_string("%.1f KiB", c / 1024)).otherwise(F.format_string("%.1f MiB", c / 1048576))


def latency_label(ms: Column) -> Column:
    """Milliseconds below a second, seconds with one digit below a minute, then minutes and seconds."""
    seconds = F.floor(ms / 1000)
    return F.when(ms.isNull() | (ms < 0), "—").when(ms < 1000, F.format_string("%d ms", ms)).when(ms < 60000, F.format_string("%.1f s", F.floor(ms / 100) / 10)).otherwise(F.format_string("%d m %d s", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60)).cast("long")))


def age_label(hours: Column) -> Column:
    return F.when(hours.isNull(), "—").when(hours < 1, "<1 h").when(hours < 48, F.format_string("%d h", F.floor(hours))).otherwise(F.format_string("%d d", F.floor(hours / 24)))


def usage_label(*parts: tuple[Column, str]) -> Column:
    """Measured amounts with their units; what was not measured is not named, and nothing at all is a dash."""
    named = F.concat_ws(", ", *[F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(" " + unit))) for c, unit in parts])
    return F.coalesce(text_or_null(named), F.lit("—"))


def joined_line(*parts: Column, separator: str = " · ") -> Column:
    """The parts that are there, in their order."""
    return F.concat_ws(separator, *[text_or_null(F.trim(p)) for p in parts])


def content_level(c: Column, blocked: str = CHALLENGE_TEXT, short: int = 80, long: int = 400) -> Column:
    """How much a page holds: 0 nothing or a challenge, 1 a line, 2 a short text, 3 a long one, 4 a long one in paragraphs."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when((body == "") | body.rlike(blocked), 0).when(F.char_length(body) < short, 1).when(F.char_length(body) < long, 2).when(~body.contains("\n\n"), 3).otherwise(4)


def site_url(base: str, path: Column) -> Column:
    """A URL for a path of the site; null for anything that is no absolute path."""
    return F.when(path.startswith("/"), F.concat(F.lit(base), path))
