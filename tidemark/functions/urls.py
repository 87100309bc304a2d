"""URL clean-up, domain rules and public-address predicates."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

#: Query parameters that only track.
TRACKING = r"^(?i)(utm_[^=]*|spm|from|source)(=|$)"

#: Networks that aren't public.
UNSAFE_IPV4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "224.0.0.0/4",
    "240.0.0.0/4",
]
UNSAFE_IPV6 = ["::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8"]
#: A wrapper page of one host that names the page it stands for.
WRAPPER_HOST, WRAPPER_PATH, WRAPPER_TARGET = "mp.weixin.qq.com", "wappoc_appmsgcaptcha", "target_url"


def _query(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("?")), F.regexp_replace(url, r"^[^?]*\?", "")).otherwise("")


def _parameters(query: Column) -> Column:
    """Rows (key, at, value) of a query in order, decoded; broken ones are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))

    def read(p: Column, at: Column) -> Column:
        key, value = F.try_url_decode(F.substring_index(p, "=", 1)), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", ""))
        return F.when(key.isNotNull() & value.isNotNull(), F.struct(key.alias("key"), at.alias("at"), value.alias("value")))

    return F.array_compact(F.transform(parts, read))


#: What a path may hold as it is, and what stays when it is encoded anew.
PATH_AS_IT_IS, PATH_KEPT = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%]*$", "$&+,/:;=@"


def encoded_path(path: Column) -> Column:
    """A path with percent escapes: as it is if it may be, else decoded and encoded anew."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.url_encode(plain)
    for coded, character in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in PATH_KEPT)):
        out = F.replace(out, F.lit(coded), F.lit(character))
    return F.when(path.rlike(PATH_AS_IT_IS), path).otherwise(out)


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    step = lambda kept, p: F.when(p == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)).when(p == ".", kept).otherwise(F.concat(kept, F.array(p)))
    joined = lambda kept: F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.aggregate(parts, none, step, joined)).otherwise(path)


def resolved(base: Column, href: Column) -> Column:
    """The address that ``href`` means on the page ``base``; null where the base isn't absolute."""
    page = F.regexp_replace(F.trim(base), "#.*$", "")
    place = F.substring_index(page, "?", 1)
    origin = F.regexp_extract(place, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    link, fragment = F.regexp_extract(href, "^[^#]*", 0), F.regexp_extract(href, "#.*$", 0)
    path, query = F.substring_index(link, "?", 1), F.regexp_extract(link, r"\?.*$", 0)
    folder = F.regexp_replace(F.substr(place, F.char_length(origin) + 1), "[^/]*$", "")
    below = F.concat(F.when(folder == "", "/").otherwise(folder), path)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(origin == "", None)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(origin, "^[^/]*", 0), href))
        .when(F.startswith(path, F.lit("/")), F.concat(origin, without_dots(path), query, fragment))
        .when((path == "") & (query == ""), F.concat(page, fragment))
        .when(path == "", F.concat(place, query, fragment))
        .otherwise(F.concat(origin, without_dots(below), query, fragment))
    )


def _cleaned(url: Column) -> Column:
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    whole = F.substring_index(base, "?", 1)
    scheme = F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    rest = F.substr(whole, F.char_length(scheme) + 1)
    authority = F.regexp_extract(rest, "^//[^/]*", 0)
    head = F.concat(F.lower(scheme), authority, let(F.substr(rest, F.char_length(authority) + 1), encoded_path))
    kept = F.array_sort(F.filter(_parameters(_query(base)), lambda p: ~F.concat(p["key"], F.lit("=")).rlike(TRACKING)))
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(kept, lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"])))
    return F.when(F.size(pairs) > 0, F.concat_ws("?", head, F.array_join(pairs, "&"))).otherwise(head)


def wrapped_target(url: Column) -> Column:
    """The address that a wrapper page stands for; null if it isn't one."""
    targets = F.transform(F.filter(_parameters(F.regexp_replace(_query(url), "#.*$", "")), lambda p: p["key"] == WRAPPER_TARGET), lambda p: p["value"])
    target = F.try_element_at(targets, F.lit(1))
    wrapper = (host(url) == WRAPPER_HOST) & F.contains(F.try_parse_url(url, F.lit("PATH")), F.lit(WRAPPER_PATH))
    return F.when(wrapper & target.rlike("^(?i)https?://"), target)


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; the query sorted by key and encoded anew.

    Parameters of one key keep their order.  A wrapper page gives the page it stands for.
    """
    return _cleaned(F.coalesce(wrapped_target(F.trim(url)), url))


def host(url: Column) -> Column:
    """Lower-case host; null where the URL can't be read."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def official_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def in_domains(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    found = F.lit(False)
    for domain in domains:
        d = domain.lower().lstrip(".")
        found = found | (name == d) | F.endswith(name, F.lit("." + d))
    return F.coalesce(found, F.lit(False))


def allowed_url(url: Column, domains: list[str]) -> Column:
    web = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host(url).isNotNull()
    return F.coalesce(web & (in_domains(host(url), domains) if domains else F.lit(True)), F.lit(False))


def trust_for_url(url: Column, high: list[str], medium: list[str], source_trust: Column, source_kind: Column) -> Column:
    """High and medium lists first, then the trust of a source that isn't a search."""
    name = host(url)
    return (
        F.when(in_domains(name, high), "high")
        .when(in_domains(name, medium) | in_domains(name, ["edu.cn", "gov.cn"]), "medium")
        .when(source_kind != "search", source_trust)
        .otherwise("low")
    )


def ipv4_number(address: Column) -> Column:
    """Dotted quad as a number; null if it isn't one."""
    parts = F.split(address, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    valid = address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(valid, number)


def _network(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net[0]), int(net[-1])


def _public_number(n: Column) -> Column:
    unsafe = F.lit(False)
    for cidr in UNSAFE_IPV4:
        unsafe = unsafe | n.between(*_network(cidr))
    return F.coalesce(~unsafe, F.lit(False))


def public_ipv4(address: Column) -> Column:
    return let(ipv4_number(address), _public_number)


def ipv6_groups(address: Column) -> Column:
    """The eight groups of an address as four hex digits each, joined; null if it isn't one.

    A dotted tail counts as two groups and ``::`` as the groups that are missing.
    """
    low = F.lower(address)
    number = ipv4_number(F.regexp_extract(low, r"(\d+\.\d+\.\d+\.\d+)$", 1))
    two = let(number, lambda n: F.concat(F.lpad(F.hex(F.shiftright(n, 16)), 4, "0"), F.lit(":"), F.lpad(F.hex(n.bitwiseAND(65535)), 4, "0")))
    plain = F.when(low.rlike(r"\d\.\d"), F.concat(F.regexp_replace(low, r"\d+\.\d+\.\d+\.\d+$", ""), F.lower(two))).otherwise(low)
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")

    def whole(p: Column) -> Column:
        left, right = groups(F.substring_index(p, "::", 1)), groups(F.regexp_replace(p, "^.*::", ""))
        gap = F.greatest(8 - F.size(left) - F.size(right), F.lit(0))
        return F.when(F.contains(p, F.lit("::")), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).when(~p.rlike("^:|:$"), groups(p))

    def valid(p: Column) -> Column:
        return F.when(p.rlike(r"^[0-9a-f:]+$") & ~p.rlike(":::|::.*::|[0-9a-f]{5}"), let(whole(p), lambda g: F.when(F.size(g) == 8, F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))))

    return let(plain, valid)


def public_ipv6(address: Column) -> Column:
    """Whether an IPv6 address is public; one that maps an IPv4 address is judged as that."""

    def judged(digits: Column) -> Column:
        unsafe = F.lit(False)
        for cidr in UNSAFE_IPV6:
            low, high = _network(cidr)
            unsafe = unsafe | digits.between(f"{low:032x}", f"{high:032x}")
        number = F.conv(F.substring(digits, 25, 8), 16, 10).try_cast("long")
        return F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), _public_number(number)).otherwise(~unsafe)

    return F.coalesce(let(ipv6_groups(address), judged), F.lit(False))


def public_url(url: Column) -> Column:
    """http(s), a host that isn't local, no user, and a public address if it is one."""
    name = host(url)
    numeric = F.coalesce(name.rlike(r"^[0-9.]+$"), F.lit(False))
    inner = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?\[([^\]]*)\]", 1)
    six = inner != ""
    dotless = F.regexp_replace(name, r"\.$", "")
    port = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    proper = (port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & name.isNotNull() & proper & (dotless != "") & (dotless != "localhost") & ~F.endswith(dotless, F.lit(".localhost"))
    return F.coalesce(ok & F.try_parse_url(url, F.lit("USERINFO")).isNull() & F.when(six, public_ipv6(inner)).otherwise(~numeric | public_ipv4(name)), F.lit(False))


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)
