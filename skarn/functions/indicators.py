"""The catalog of indicators of compromise and the expressions over it.

The patterns avoid look-around and back-references, so that other engines can run them too; case is folded by ``(?i)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number ranges, brackets and prefixes of the indicator formats.
SEGMENT = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])"
DOT = r"[\[\(\\{<]*(?:\.|dot)[\]\)\\}>]*"
AT = r"(?:@|[\[\(\\{<]+(?:@|at)[\]\)\\}>]+)"
COLON = r"[\[\(\\{<]*:[\]\)\\}>]*"
GROUP = r"[0-9a-f]{1,4}"

LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
#: A dot between the labels of a host: plain, in brackets, or a word in brackets (a bare "dot" may be part of a word).
HOST_DOT = r"(?:[\[\(\\{<]*\.[\]\)\\}>]*|[\[\(\\{<]+dot[\]\)\\}>]+)"

# Country codes by first letter, generic and reserved top-level domains, schemes (defanged ones too), and
# top-level domains that are file extensions as well.
COUNTRIES = (
    "a[cdefgilmoqrstuwxz]", "b[abdefghijmnorstvwyz]", "c[acdfghiklmnoruvwxyz]", "d[ejkmoz]", "e[cegrstu]", "f[ijkmor]", "g[abdefghilmnpqrstuwy]", "h[kmnrtu]", "i[delmnoqrst]",
    "j[emop]", "k[eghimnprwyz]", "l[abcikrstuvy]", "m[acdeghklmnopqrstuvwxyz]", "n[acefgilopruz]", "om", "p[aefghklmnrstwy]", "qa", "r[eosuw]", "s[abcdeghijklmnorstuvxyz]",
    "t[cdfghjklmnortvwz]", "u[agksyz]", "v[aceginu]", "w[fs]", "y[et]", "z[amw]",
)
GENERIC = (
    "com", "net", "org", "info", "biz", "name", "pro", "edu", "gov", "mil", "int", "arpa", "aero", "asia", "cat", "coop", "jobs", "mobi", "museum", "tel", "travel", "app", "dev", "page", "cloud", "online", "site",
    "website", "space", "store", "shop", "club", "live", "news", "blog", "link", "click", "download", "email", "host", "top", "xyz", "icu", "work", "world", "today", "tech", "zone", "example", "test", "invalid", "localhost", "onion",
)
SCHEMES = ("https", "http", "hxxps", "hxxp", "sftp", "ftps", "ftp", "fxp", "ssh", "ldaps", "ldap", "smb", "tcp", "udp", "wss", "ws", "file", "telnet", "rtsp", "socks5")
ALSO_FILES = ("cc", "md", "pl", "ps", "py", "rs", "sh", "so", "zip", "mov")


def top_level_domains(text: str) -> list[str]:
    """The names of a published list, one per line: lower case, without comments and internationalized (``xn--``) names; longest first."""
    names = {x.strip().lower() for x in text.split("\n")}
    return sorted((x for x in names if x and x[0] != "#" and "-" not in x), key=lambda x: (-len(x), x))


def url_pattern(tlds: tuple[str, ...] | list[str] = (*GENERIC, *COUNTRIES), schemes: tuple[str, ...] | list[str] = SCHEMES, also_files: tuple[str, ...] | list[str] = ALSO_FILES) -> str:
    """URLs with one of the schemes, and hosts without one, defanged or not, with their port, path, query and fragment.

    A host without a scheme ends in a top-level domain; where that is a file extension too, it needs ``www`` or a
    path. Punctuation at the very end isn't part of it.
    """
    tail = r"(?:[/?#](?:[^ \t\r\n\"'<>]*[^ \t\r\n\"'<>.,;:!?()\[\]])?)?"
    domains, odd = "|".join(tlds), "|".join(also_files)
    labels, port = rf"(?:[a-z0-9][a-z0-9-]*{HOST_DOT})", "(?::[0-9]{1,5})?"
    full = rf"(?:{'|'.join(schemes)}){COLON}//[^ \t\r\n\"'<>]*[^ \t\r\n\"'<>.,;:!?()\[\]]"
    path = tail[:-1].replace("[/?#]", "/", 1)
    named = rf"www{HOST_DOT}{labels}+(?:{domains}|{odd})\b{port}{tail}"
    # A class of country codes loses the letters that make one of ``also_files``.
    sure = [t if "[" not in t else t[0] + "[" + "".join(c for c in t[2:-1] if t[0] + c not in also_files) + "]" for t in tlds if t not in also_files]
    return rf"(?i)\b(?:{full}|{named}|{labels}+(?:(?:{domains}|{odd})\b{port}{path}|(?:{'|'.join(sure)})\b{port}))"


def ipv6_pattern() -> str:
    """All forms of RFC 4291, defanged colons too: with a zone, with an embedded IPv4, in full, and with ``::`` anywhere but alone."""
    g, s = GROUP, COLON
    v4 = rf"{SEGMENT}(?:{DOT}{SEGMENT}){{3}}"
    forms = [
        rf"\bfe80{s}(?:{s}{g}){{0,4}}%[0-9a-z]+",
        rf"\b(?:{g}{s}){{6}}{v4}\b", rf"\b(?:{g}{s}){{1,5}}{s}(?:{g}{s}){{0,4}}{v4}\b", rf"{s}{s}(?:ffff{s}(?:0{{1,4}}{s})?)?{v4}\b",
        rf"\b(?:{g}{s}){{7}}{g}\b",
        *(rf"\b(?:{g}{s}){{1,{i}}}(?:{s}{g}){{1,{7 - i}}}\b" for i in range(1, 7)),
        rf"\b(?:{g}{s}){{1,7}}{s}", rf"{s}{s}{g}(?:{s}{g}){{0,6}}\b",
    ]
    return rf"(?i)(?:{'|'.join(forms)})"


#: name and pattern in order of precedence. An embedded IPv4 is part of the IPv6 pattern.
# Lengths of the digests, forms of the numbered ids.
CATALOG: tuple[tuple[str, str], ...] = (
    ("IPv4", rf"(?i)\b{SEGMENT}(?:{DOT}{SEGMENT}){{3}}(?::[0-9]{{1,5}}|/[0-9]{{1,2}})?\b"),
    ("IPv6", ipv6_pattern()),
    ("EMAIL", rf"(?i)[a-z0-9_%+.-]+{AT}(?:{LABEL}{DOT})+{LABEL}"),
    ("SHA512", r"(?i)\b[0-9a-f]{128}\b"),
    ("SHA256", r"(?i)\b[0-9a-f]{64}\b"),
    ("SHA1", r"(?i)\b[0-9a-f]{40}\b"),
    ("MD5", r"(?i)\b[0-9a-f]{32}\b"),
    ("CVE", r"(?i)\bcve-[0-9]{4}-[0-9]{4,6}\b"),
    ("CWE", r"(?i)\bcwe-[0-9]{1,4}\b"),
    ("CAPEC", r"(?i)\bcapec-[0-9]{1,4}\b"),
    ("ATTACK", r"(?i)\b(?:TA|T|DS|S|G|M)[0-9]{4}(?:\.[0-9]{3})?\b"),
    ("FILE", r"(?i)\b[a-z0-9_-]+\.(?:exe|dll|sys|bat|ps1|js|vbs|jar|sh|php|html?|docx?|xlsx?|pdf|zip|rar|lnk)\b"),
    ("PATH", r"(?i)(?:\b[a-z]:\\[a-z0-9_.\\-]+|/[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+)"),
    ("REGISTRY", r"(?i)\b(?:hkey_local_machine|hkey_current_user|hklm|hkcu|hku)\\[a-z0-9_@^!#.:/$%&+={}\\-]+"),
    ("URL", url_pattern()),
)
PATTERN = dict(CATALOG)

# Words that stand for protected indicators; the arguments of a command leave only a space.
STAND_INS = {
    "URL": "url", "Host": "host", "IPv4": "host", "IPv6": "host", "EMAIL": "email", "DocumentFile": "document", "ExecutableFile": "executable", "MD5": "file", "SHA1": "file",
    "SHA256": "file", "SHA512": "file", "PATH": "path", "REGISTRY": "registry", "CVE": "vulnerability", "Arguments": "",
}

#: What is protected besides the catalog's kinds, in order; of the overlapping ones the one that starts first counts.
PROTECTED: tuple[tuple[str, str], ...] = (
    ("URL", rf"(?i)\b(?:{'|'.join(SCHEMES)}){COLON}//[^ \t\r\n\"'<>]*[^ \t\r\n\"'<>.,;:!?()\[\]]"),
    ("ExecutableFile", r"(?i)\b[a-z0-9_-]+\.(?:exe|dll|sys|bat|ps1|js|vbs|jar|sh|php|lnk|scr|cmd|msi)\b"),
    ("DocumentFile", r"(?i)\b[a-z0-9_-]+\.(?:docx?|xlsx?|pptx?|pdf|rtf|txt|html?|csv|xml|zip|rar)\b"),
    ("Host", rf"(?i)\b(?:{LABEL}{HOST_DOT})+(?:{'|'.join((*GENERIC, *COUNTRIES))})\b"),
    ("Arguments", r"(?i)(?:[ \t](?:/[a-z?]\b|--?[a-z][a-z0-9_-]*)(?:[=:][^ \t\r\n]+)?)+"),
)

# Masks in the order they are applied.
MASKS: tuple[tuple[str, str], ...] = (
    (r"\(?http(s)?://[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-zA-Z0-9()]{2,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)", "[URL]"),
    (r"\(?(http|hxxp)(s)?:\/\/[-a-zA-Z0-9@:%._\+~#=]{2,256}(\[)?\.(\])?[a-zA-Z0-9()]{2,6}\b([-a-zA-Z0-9()@:%_\+.~#?&\/\/=]*)", "[OBFUSCATED URL]"),
    (r"\b(?:[0-9]{1,3}\[?\.\]?){3}[0-9]{1,3}\b", "[IP]"),
    (r"\b[A-Fa-f0-9]{32}\b|\b[A-Fa-f0-9]{40}\b|\b[A-Fa-f0-9]{64}\b", "[HASH]"),
)

# Brackets around defanged separators, and what they stand for.
REFANG: tuple[tuple[str, str], ...] = (
    (r"(?i)[\[\(\\{<]+(?:\.|dot)[\]\)\\}>]+", "."),
    (r"(?i)[\[\(\\{<]+(?:@|at)[\]\)\\}>]+", "@"),
    (r"[\[\(\\{<]+:[\]\)\\}>]+", ":"),
)

TECHNIQUE_ID = r"\b(?:TA|T|S|G|M)[0-9]{4}(?:\.[0-9]{3})?\b"


#: What a text must hold, in lower case, to have a match; texts without it aren't scanned for the pattern.
GATES = {"CVE": "cve-", "CWE": "cwe-", "CAPEC": "capec-", "REGISTRY": "hk"}


def found(t: Column, name: str) -> Column:
    """All matches of one catalog entry, in order; an empty array for null text."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all(t, F.lit(PATTERN[name]), F.lit(0))
    return F.coalesce(F.when(F.contains(F.lower(t), F.lit(GATES[name])), hits) if name in GATES else hits, none)


def indicators(t: Column) -> Column:
    """``kind, value`` of every match of every catalog entry; entries may overlap, spans are resolved elsewhere."""

    def named(kind: str) -> Column:
        return F.transform(found(t, kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.flatten(F.array(*[named(k) for k, _ in CATALOG]))


def mask(t: Column) -> Column:
    """URLs, defanged URLs, addresses and hashes replaced by their masks, in this order."""
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), MASKS, t)


def refang(t: Column) -> Column:
    """Defanged separators replaced by ``.``, ``@`` and ``:``."""
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), REFANG, t)


def technique_ids(t: Column) -> Column:
    """The different technique ids of a text, sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(t, F.lit(TECHNIQUE_ID), F.lit(0)), F.array().cast("array<string>"))))
