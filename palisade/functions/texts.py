"""Texts shown to people, and checks on text: URLs, addresses, patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.base import any_of, pick, strip, text_after, text_before

# One sentence per category.
WHY = {
    "secret": "Credential exposure risk: can lead to unauthorized API access, account takeover, or complete infrastructure compromise.",
    "cve": "Known exploit/dependency risk: introduces public, cataloged vulnerabilities into the runtime environment via third-party packages.",
    "misconfig": "Unsafe runtime/security posture: leaves default credentials, open ports, or incorrect access rights exposed in production environments.",
    "sast": "Code-level vulnerability: direct implementation flaws (like SQL injection or buffer overflows) that can be exploited dynamically.",
    "drift": "Deviation from secure baseline: indicates undocumented or unauthorized runtime modifications that break security policy constraints.",
}
WHY_OTHER = "General security exposure: deviates from security best practices and increases the attack surface of the application."
# The longer texts.
IMPACT = {
    "secret": "An attacker can steal this hardcoded credential and gain direct access to your databases, cloud services, external APIs, or communication channels. This can lead to massive data theft, service abuse, or severe financial losses.",
    "cve": " with known public vulnerabilities means attackers can exploit well-documented bugs. Depending on the specific bug, they could crash your server, steal data, or run malicious code on your systems.",
    "root": "Running your application containers as 'root' (admin) means if an attacker compromises the app, they instantly gain admin control over the container. This makes it significantly easier to break out and compromise the host server.",
    "debug": "Enabling debug mode in production exposes internal code stack traces, server path details, and environment variables to the public whenever an error occurs. Attackers use this blueprint to locate further entry points.",
    "image": "Using unpinned, outdated, or generic base images introduces pre-existing vulnerabilities into your container environment and makes your builds unpredictable, increasing the risk of code breaking unexpectedly.",
    "web": "Missing HTTP security headers or weak SSL/TLS settings leave your users vulnerable to browser-based attacks such as clickjacking, cross-site scripting (XSS), or having their traffic intercepted (man-in-the-middle).",
    "database": "Weak database configurations (such as empty passwords or allowing connections from any IP) let attackers brute-force or connect directly to your database, exposing all stored sensitive data to theft or deletion.",
    "drift": "Unauthorized settings changes or drift from your approved security baseline mean that security controls might have been disabled or altered, leaving unknown configuration gaps or causing system instability.",
    "other": "This misconfiguration weakens the defensive layers of your application. It could allow unauthorized users to bypass security controls, view internal system data, or trigger service disruptions.",
}
# Hosts that are never public, and the special address ranges.
LOCAL_HOSTS = ["localhost", "localhost.localdomain", "127.0.0.1", "::1", "0.0.0.0"]
SPECIAL_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
]
SPECIAL_IPV6 = r"^(::1?$|::ffff:|64:ff9b:1:|100:0?:|100::|2001:db8:|2001:0?:|f[cd]|fe[89ab]|ff)"


def why_it_matters(category: Column) -> Column:
    return pick(F.lower(category), WHY, WHY_OTHER)


def impact(category: Column, rule_id: Column, title: Column, cve_id: Column) -> Column:
    """Longer explanation, by category, then by rule family or words of the title.

    Rule families are recognised with or without a vendor prefix (`WEB-001`, `ACME-WEB-001`).
    """
    cat, rule, words = F.lower(category), F.upper(rule_id), F.lower(title)
    says = lambda *keys: any_of([words.contains(k) for k in keys])
    family = lambda pattern: rule.rlike("^(?:[A-Z0-9]+-)?" + pattern)
    library = F.when(F.coalesce(cve_id, F.lit("")) == "", "a third-party library").otherwise(cve_id)
    return (
        F.when(cat == "secret", IMPACT["secret"])
        .when(cat == "cve", F.concat(F.lit("Using "), library, F.lit(IMPACT["cve"])))
        .when(family("INFRA-001$") | says("root user"), IMPACT["root"])
        .when(family("MISCONFIG-001$") | says("debug"), IMPACT["debug"])
        .when(family("INFRA-002$") | says("base image"), IMPACT["image"])
        .when(family("WEB-") | says("headers", "ssl", "tls"), IMPACT["web"])
        .when(family("DB-") | says("database", "sql"), IMPACT["database"])
        .when(cat == "config_drift", IMPACT["drift"])
        .otherwise(IMPACT["other"])
    )


def parse_git_evidence(evidence: Column) -> Column:
    """Map of the `Key: value | Key: value` parts; keys in lower case, the last of a key counts."""
    parts = F.filter(F.split(evidence, r"\|"), lambda s: s.contains(":"))
    pairs = F.transform(
        parts,
        lambda s: F.struct(
            F.lower(strip(text_before(s, ":"))).alias("key"), strip(text_after(s, ":")).alias("value")
        ),
    )
    nothing = F.create_map().cast("map<string,string>")
    return F.aggregate(
        pairs,
        nothing,
        lambda found, p: F.map_concat(
            F.map_filter(found, lambda key, _: key != p["key"]), F.create_map(p["key"], p["value"])
        ),
    )


def patch_added_lines(patch: Column) -> Column:
    """The lines a patch adds, without the sign."""
    added = F.filter(F.split(patch, "\n"), lambda s: s.startswith("+") & ~s.startswith("+++"))
    return F.array_join(F.transform(added, lambda s: F.substr(s, F.lit(2))), "\n")


def is_allowed_git_url(url: Column) -> Column:
    return (url.startswith("https://") | url.startswith("http://")) & ~url.contains(" ")


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and brackets."""
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#]*))"
    return F.lower(F.concat(F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)))


def is_webhook_url(url: Column) -> Column:
    """https with a host that is not a name of this machine; addresses are checked separately."""
    host = url_host(url)
    return F.lower(url).startswith("https://") & (host != "") & ~host.isin(LOCAL_HOSTS)


def _ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return number


def is_public_address(ip: Column) -> Column:
    """Not loopback, private, link-local, multicast, reserved or unspecified; bad text is not public."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = ip.rlike(rf"^{octet}(\.{octet}){{3}}$")
    number = _ipv4_number(ip)
    inside = []
    for cidr in SPECIAL_IPV4:
        text, bits = cidr.split("/")
        low = sum(int(p) << (24 - 8 * i) for i, p in enumerate(text.split(".")))
        inside.append(number.between(low, low + (1 << (32 - int(bits))) - 1))
    v6 = ip.contains(":") & ip.rlike(r"(?i)^[0-9a-f:.]+$")
    return (
        F.when(v4, ~any_of(inside)).when(v6, ~F.lower(ip).rlike(SPECIAL_IPV6)).otherwise(F.lit(False))
    )
