"""URL rules: host extraction and the noise, payload and raw-address predicates."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .binding import let

_BAD_PERCENT = r"%(?:[^0-9A-Fa-f]|[0-9A-Fa-f](?:[^0-9A-Fa-f]|\z)|\z)"
_USERINFO = r"\A[A-Za-z0-9\-._:~!$&'()*+,;=%@]*\z"
# ASCII characters that may not stand in a host, and escapes of ASCII other than %25
_BAD_HOST = (
    r"[\x00-\x7F&&[^A-Za-z0-9\-._~!$&'()*+,;=<>\"\[\]:%]]"
    r"|%(?!25|[89A-Fa-f][0-9A-Fa-f])"
)
# nothing to validate: no user, escape, bracket or control character
_SIMPLE_URL = r"\Ahttps?://([A-Za-z0-9._\-]*+)(?::[0-9]*+)?(?:[/?#][^%\x00-\x1F\x7F]*+)?\z"


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port or brackets; NULL if the URL is malformed.

    Escapes inside the host are validated but not decoded: they stand for
    non-ASCII bytes only, which no rule here looks at.
    """
    simple = F.lower(F.regexp_extract(url, _SIMPLE_URL, 1))
    return F.when(url.rlike(_SIMPLE_URL), simple).otherwise(_general_host(url))


def _general_host(url: Column) -> Column:
    before_fragment = F.regexp_extract(url, r"\A([^#]*)", 1)
    fragment = F.regexp_extract(url, r"\A[^#]*#?([\s\S]*)", 1)
    after_scheme = F.regexp_extract(url, r"\Ahttps?://([^?#]*)", 1)
    path = F.regexp_extract(after_scheme, r"\A[^/]*([\s\S]*)", 1)
    rest_is_valid = (
        url.rlike(r"\Ahttps?://")
        & ~before_fragment.rlike(r"[\x00-\x1F\x7F]")
        & ~path.rlike(_BAD_PERCENT)
        & ~fragment.rlike(_BAD_PERCENT)
    )
    authority = F.regexp_extract(url, r"\Ahttps?://([^/?#]*)", 1)
    return F.when(rest_is_valid, let(authority, _authority_host))


def _authority_host(authority: Column) -> Column:
    user = F.regexp_extract(authority, r"\A([\s\S]*)@", 1)
    host_port = F.regexp_extract(authority, r"\A(?:[\s\S]*@)?([^@]*)\z", 1)
    # the last colon outside brackets starts the port, which must be digits or empty
    host = F.regexp_extract(host_port, r"\A([\s\S]*?)(?::[0-9]*)?\z", 1)
    bracketed = host_port.startswith("[")
    well_formed = (
        user.rlike(_USERINFO)
        & ~user.rlike(_BAD_PERCENT)
        & ~host.rlike(_BAD_HOST)
        & F.when(bracketed, host_port.rlike(r"\](?::[0-9]*)?\z"))
        .otherwise(host_port.rlike(r"\A[^:]*\z|:[0-9]*\z"))
    )
    bare = F.when(bracketed, F.regexp_extract(host, r"\A\[([\s\S]*)\]\z", 1)).otherwise(host)
    return F.when(well_formed, F.lower(bare))


def is_reserved_host(url: Column) -> Column:
    """Loopback, placeholder and reserved names, matched exactly or by reserved ending."""
    return _host_is_reserved(url_host(url))


def is_doc_host(url: Column) -> Column:
    """A documentation site or one of its subdomains."""
    return _host_is_doc(url_host(url))


def _host_is_reserved(host: Column) -> Column:
    by_ending = host.rlike(r"\." + _any_of(P.RESERVED_TOP_LEVELS) + r"\z")
    return F.coalesce(host.isin(*P.RESERVED_HOSTS) | by_ending, F.lit(False))


def _host_is_doc(host: Column) -> Column:
    return F.coalesce(host.rlike(r"(?:\A|\.)" + _any_of(P.DOCUMENTATION_HOSTS) + r"\z"), F.lit(False))


_QUIET_SHAPE = r"[{}#]|\.git\z|/" + _any_of(P.NAVIGATION_SEGMENTS) + "/"
# the authority ends in a listed name: necessary for a reserved or documentation host
_LISTED_ENDING = (
    r"(?iu)\Ahttps?://(?:[^/?#]*[@.\[])?"
    + _any_of(P.RESERVED_HOSTS + P.RESERVED_TOP_LEVELS + P.DOCUMENTATION_HOSTS)
    + r"\]?(?::[0-9]*)?(?:[/?#]|\z)"
)

# a simple URL whose host is reserved or a documentation site
_SIMPLE_LISTED = (
    r"\Ahttps?://(?i:" + _any_of(h for h in P.RESERVED_HOSTS if ":" not in h)
    + r"|[A-Za-z0-9._\-]*\." + _any_of(P.RESERVED_TOP_LEVELS)
    + r"|(?:[A-Za-z0-9._\-]*\.)?" + _any_of(P.DOCUMENTATION_HOSTS)
    + r")(?::[0-9]*+)?(?:[/?#][^%\x00-\x1F\x7F]*+)?\z"
)


def is_noise_url(url: Column) -> Column:
    """References and navigation: never a destination worth reporting.

    A simple URL is decided by one search; the host of another is taken apart only when the
    authority ends in a listed name.
    """
    listed = let(_general_host(url), lambda host: _host_is_reserved(host) | _host_is_doc(host))
    return (
        F.when(url.rlike(_QUIET_SHAPE), True)
        .when(url.rlike(_SIMPLE_LISTED), True)
        .when(url.rlike(_SIMPLE_URL), False)
        .when(url.rlike(_LISTED_ENDING), listed)
        .otherwise(False)
    )


def is_payload_url(url: Column) -> Column:
    """Raw-content hosts anywhere in the URL, or an executable ending."""
    lower = F.lower(url)
    return lower.rlike(
        _any_of(P.PAYLOAD_HOSTS) + r"|\." + _any_of(P.PAYLOAD_EXTENSIONS) + r"\z"
    )


def is_raw_ip_url(url: Column) -> Column:
    """A dotted-quad address right after a scheme, anywhere in the text."""
    return url.rlike(P.RAW_IP_URL)
