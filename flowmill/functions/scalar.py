"""Column expressions: scores, names, addresses, fingerprints, identifiers.  All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_BANDS = ((0.60, "LOW"), (0.75, "MEDIUM"), (0.90, "HIGH"))
ATTACK_CLASSES = ("benign", "volumetric-ddos", "c2-beaconing", "dga-dns-tunnelling", "encrypted-malware", "recon-scanning", "data-exfiltration")
SERVICE_PORTS = (1080, 1194, 1433, 1521, 3128, 3306, 3389, 5432, 5900, 6379, 8000, 8080, 8443, 9200, 27017)
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}
TCP_FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}
# (first time-to-live | options) of TCP stacks and their families, tried in this order.
FAMILY_LAYOUTS = (
    (r"\|(mss,nop,ws,nop,nop,sok|mss,nop,nop,sok|mss,nop,ws,sok,ts)$", "windows"),
    (r"\|(mss,sok,ts,nop,ws|mss,sok,ts|mss,nop,nop,sok,nop,ws)$", "linux"),
    (r"\|mss,nop,ws,nop,nop,ts", "bsd"),
    (r"^(32|128)\|", "windows"),
    (r"^64\|mss,sok(,|$)", "linux"),
    (r"^64\|mss,nop(,.*)?,ts(,|$)", "bsd"),
)
OPTION_NAMES = {0: "eol", 1: "nop", 2: "mss", 3: "ws", 4: "sok", 5: "sack", 8: "ts"}
TECHNIQUES = {
    "volumetric-ddos": ("T1498.001", "Direct Network Flood"),
    "c2-beaconing": ("T1071.001", "Application Layer Protocol: Web Protocols"),
    "dga-dns-tunnelling": ("T1568.002", "Dynamic Resolution: Domain Generation Algorithms"),
    "encrypted-malware": ("T1573", "Encrypted Channel"),
    "recon-scanning": ("T1046", "Network Service Discovery"),
    "data-exfiltration": ("T1048", "Exfiltration Over Alternative Protocol"),
}
ICMP_REPLY_TO_REQUEST = {0: 8, 14: 13, 16: 15, 18: 17, 129: 128}
TLS_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0200: "s2", 0x0100: "s1"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(x: Column, unit: int) -> Column:
    """x in whole units, rounded down, in integers throughout: nanoseconds are beyond a double's 53 bits."""
    return F.call_function("div", x - F.pmod(x, F.lit(unit).cast("long")), F.lit(unit).cast("long"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def margin(value: Column, threshold: float, span: float) -> Column:
    """How far past a threshold, in units of ``span``; a step where span is not positive."""
    if span <= 0:
        return F.when(value >= threshold, 1.0).otherwise(0.0)
    return clamp01((value - threshold) / span)


def confidence(margins: list[Column]) -> Column:
    if not margins:
        return F.lit(0.5)
    total = sum(margins[1:], margins[0])
    return F.round(0.5 + 0.5 * total / len(margins), 4)


def severity(score: Column) -> Column:
    out = F.lit("CRITICAL")
    for limit, name in reversed(SEVERITY_BANDS):
        out = F.when(score < limit, name).otherwise(out)
    return out


def alert_severity(given: Column, score: Column) -> Column:
    """The severity given, or by a score of 0 to 100."""
    up = F.upper(given)
    fallback = F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")
    return F.when(up.isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), up).otherwise(fallback)


def confidence_score(value: Column) -> Column:
    scaled = F.when(value <= 1.0, value * 100.0).otherwise(value)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(scaled, 0).cast("int")))


def ratio(x: Column, y: Column) -> Column:
    """x over y, a denominator of one at least."""
    return x.cast("double") / F.greatest(F.lit(1.0), y.cast("double"))


def novelty(count: Column, full: int = 8) -> Column:
    """One for a pair seen once, falling with the logarithm of its count."""
    return clamp01(1.0 - F.log1p(count.cast("double") - 1.0) / F.log1p(F.lit(float(full))))


def false_alarm_probability(power: Column, frequencies: int = 512) -> Column:
    z = power.cast("double")
    p = -F.expm1(F.lit(float(frequencies)) * F.log1p(-F.exp(-z)))
    return F.when(z <= 0, 1.0).otherwise(clamp01(p))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""

    def norm(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda x: x / t))

    return let(F.array_max(scores), lambda m: let(F.transform(scores, lambda x: F.exp(x - m)), norm))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points, flat beyond the ends."""
    out = F.lit(float(ys[-1]))
    for a, b, c, d in reversed(list(zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True))):
        out = F.when(x < b, c + (x - a) * ((d - c) / (b - a))).otherwise(out)
    return F.when(x <= xs[0], float(ys[0])).otherwise(out)


def prior_shift(p: Column, old: float, new: float) -> Column:
    """A probability learned at base rate ``old``, moved to base rate ``new``."""
    a, b = p * (new / old), (1 - p) * ((1 - new) / (1 - old))
    return a / (a + b)


# --- names


def char_entropy(s: Column) -> Column:
    """Shannon entropy of a string's characters in bits; zero for an empty one."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        p = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - p(c) * F.log2(p(c)))

    chars = F.filter(F.split(s, ""), lambda x: x != "")
    return F.when(F.length(s) > 0, let(chars, of)).otherwise(0.0)


def digit_ratio(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^0-9]", "")) / F.length(s)).otherwise(0.0)


def consonant_run(s: Column) -> Column:
    """Longest run of ASCII consonants and digits."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("([b-df-hj-np-tv-z0-9]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def labels(name: Column) -> Column:
    return F.split(name, "[.]")


def name_shape(name: Column) -> dict[str, Column]:
    return {"qname_len": F.length(name), "label_count": F.size(labels(name)), "max_label_len": F.array_max(F.transform(labels(name), F.length))}


def registrable(name: Column, suffixes: list[str]) -> Column:
    """The public suffix and one label more; without a known two-label suffix the last two labels."""

    def of(parts: Column) -> Column:
        two = F.concat_ws(".", F.slice(parts, -2, 2))
        three = F.concat_ws(".", F.slice(parts, -3, 3))
        return F.when(F.size(parts) < 2, F.concat_ws(".", parts)).when(two.isin(*suffixes) & (F.size(parts) >= 3), three).otherwise(two)

    return let(labels(F.lower(name)), of)


def stem(name: Column, suffixes: list[str]) -> Column:
    return F.element_at(F.split(registrable(name, suffixes), "[.]"), 1)


def bigrams(s: Column) -> Column:
    """Bigrams of ``^s$``; characters that names lack count as a hyphen."""
    marked = F.concat(F.lit("^"), F.regexp_replace(F.lower(s), "[^a-z0-9-]", "-"), F.lit("$"))
    return let(marked, lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda i: F.substr(m, i, F.lit(2))))


def entropy_component(entropy: Column) -> Column:
    return clamp01((entropy - 3.2) / 0.6)


def bigram_component(mean_ll: Column) -> Column:
    return clamp01((-3.2 - mean_ll) / 1.0)


def name_score(entropy: Column, mean_ll: Column) -> Column:
    return 0.4 * entropy_component(entropy) + 0.6 * bigram_component(mean_ll)


# --- addresses, ports, flows


def ip_to_int(ip: Column) -> Column:
    return F.aggregate(F.split(ip, "[.]"), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def format_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n.cast("long"), k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (24, 16, 8, 0)])


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a network in CIDR notation."""
    parts = F.split(cidr, "/")
    bits = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    low = ip_to_int(F.element_at(parts, 1))
    low = low - low % size
    return low, low + size - 1


def is_service_port(port: Column) -> Column:
    return ((port > 0) & (port < 1024)) | port.isin(*SERVICE_PORTS)


def guessed_initiator(src_port: Column, dst_port: Column) -> tuple[Column, Column]:
    """(source is the initiator, confidence) from ports alone."""
    s, d = is_service_port(src_port), is_service_port(dst_port)
    return F.when(s != d, ~s).when(src_port != dst_port, src_port > dst_port).otherwise(True), F.when(s != d, 0.75).otherwise(0.5)


def flow_key(proto: Column, src: Column, src_port: Column, dst: Column, dst_port: Column) -> tuple[Column, Column]:
    """(direction-free key, whether source is the lower end)."""
    a, b = F.struct(src.alias("ip"), src_port.alias("port")), F.struct(dst.alias("ip"), dst_port.alias("port"))
    return F.struct(proto.alias("proto"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")), a <= b


def proto_number(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in PROTOCOLS.items() for x in (k, v)])
    return F.coalesce(F.element_at(names, F.lower(F.trim(text))), text.try_cast("int"))


def flags_number(text: Column) -> Column:
    """TCP flags from a number, a hexadecimal number or letters."""
    names = F.create_map(*[F.lit(x) for k, v in TCP_FLAGS.items() for x in (k, v)])
    letters = F.aggregate(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), F.lit(0), lambda a, c: a.bitwiseOR(F.coalesce(F.element_at(names, c), F.lit(0))))
    return F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substr(text, F.lit(3)), 16, 10).cast("int")).when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(letters)


def has_flags(flags: Column, on: int, off: int = 0) -> Column:
    return (flags.bitwiseAND(F.lit(on | off)) == on) if on else (flags.bitwiseAND(F.lit(off)) == 0)


def request_type(icmp_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in ICMP_REPLY_TO_REQUEST.items() for x in (k, v)])
    return F.coalesce(F.element_at(pairs, icmp_type), icmp_type)


def timestamp_ns(value: Column) -> Column:
    """Nanoseconds of an epoch time (a number or its text) in seconds, milli-, micro- or nanoseconds, told by its size;
    decimal throughout, so that no digit is lost.  Null for what is no number."""

    def of(v: Column) -> Column:
        scale = F.when(v > 10**17, 1).when(v > 10**14, 1000).when(v > 10**11, 10**6).otherwise(10**9)
        return F.round(v * scale.cast("decimal(10,0)"), 0).cast("long")

    return let(value.try_cast("decimal(28,9)"), of)


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_since(text: Column) -> Column:
    """Epoch seconds of a number or an ISO 8601 time."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


# --- fingerprints


def initial_ttl(ttl: Column) -> Column:
    return F.when(ttl <= 32, 32).when(ttl <= 64, 64).when(ttl <= 128, 128).otherwise(255)


def tcp_fingerprint(flags: Column, ttl: Column, window: Column, mss: Column, options: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in OPTION_NAMES.items() for x in (k, v)])
    text = F.array_join(F.transform(options, lambda o: F.coalesce(F.element_at(names, o), o.cast("string"))), ",")
    return F.when(has_flags(flags, 2), F.concat_ws(":", initial_ttl(ttl).cast("string"), window.cast("string"), mss.cast("string"), text)).otherwise("")


def fingerprint_family(fingerprint: Column) -> Column:
    """Operating-system family of a TCP fingerprint: the first row of FAMILY_LAYOUTS that its first time-to-live and its
    options match."""
    shape = F.regexp_extract(fingerprint, r"^([0-9]+):[^:]*:[^:]*:([^:]*)$", 0)
    key = F.concat_ws("|", F.split_part(shape, F.lit(":"), F.lit(1)), F.split_part(shape, F.lit(":"), F.lit(4)))
    return F.coalesce(*[F.when(key.rlike(layout), family) for layout, family in FAMILY_LAYOUTS], F.lit("unknown"))


def reserved(x: Column) -> Column:
    """Whether a code point is one that clients add at random: both bytes alike, their low half 0xA."""
    return (F.pmod(x, F.lit(16)) == 10) & (F.floor(x / 256) == F.pmod(x, F.lit(256)))


def _not_reserved(values: Column) -> Column:
    return F.filter(values, lambda x: ~reserved(x))


def _hex_list(values: Column, ordered: bool) -> Column:
    text = F.transform(values, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))
    return F.array_join(F.array_sort(text) if ordered else text, ",")


def _digest(text: Column) -> Column:
    """First half of a fingerprint's hash; zeros for no text."""
    return F.when(text == "", "0" * 12).otherwise(F.left(F.sha2(text, 256), F.lit(12)))


def _prefix(transport: str, version: Column, *rest: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in TLS_VERSIONS.items() for x in pair])
    return F.concat(F.lit(transport), F.coalesce(F.element_at(codes, version), F.lit("00")), *rest)


def _two_digits(values: Column) -> Column:
    return F.format_string("%02d", F.least(F.size(values), F.lit(99)))


def alpn_code(alpn: Column) -> Column:
    """First and last character of the protocol's name; of a name that starts or ends otherwise, the low hexadecimal
    digits of its first and last byte."""
    digits = F.lower(F.hex(alpn.cast("binary")))
    plain = F.regexp_replace(alpn, "(?s)^(.).*(.)$", "$1$2")
    doubled = F.when(F.length(alpn) == 1, F.concat(alpn, alpn)).otherwise(plain)
    return F.when(alpn.isNull() | (alpn == ""), "00").when(doubled.rlike("^[A-Za-z0-9]{2}$"), doubled).otherwise(F.concat(F.substring(digits, 2, 1), F.right(digits, F.lit(1))))


def ja4(version: Column, sni: Column, ciphers: Column, extensions: Column, signatures: Column, alpn: Column, transport: str = "t") -> Column:
    """JA4 of a client hello's fields (arrays of int): counts, then a hash of the sorted ciphers, then one of the sorted
    extensions (server name and protocol left out) and the signature algorithms in their order."""
    offered, listed = _not_reserved(ciphers), _not_reserved(extensions)
    algorithms = _hex_list(_not_reserved(signatures), False)
    third = F.concat(_hex_list(F.filter(listed, lambda x: ~x.isin(0, 16)), True), F.when(algorithms == "", "").otherwise(F.concat(F.lit("_"), algorithms)))
    first = _prefix(transport, version, F.when(sni, "d").otherwise("i"), _two_digits(offered), _two_digits(listed), alpn_code(alpn))
    return F.concat_ws("_", first, _digest(_hex_list(offered, True)), _digest(third))


def ja4s(version: Column, cipher: Column, extensions: Column, alpn: Column, transport: str = "t") -> Column:
    """JA4S of a server hello's fields: its one cipher in the open, its extensions hashed in their order."""
    listed = _not_reserved(extensions)
    return F.concat_ws("_", _prefix(transport, version, _two_digits(listed), alpn_code(alpn)), _hex_list(F.array(cipher), False), _digest(_hex_list(listed, False)))


# --- identifiers and text


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name (32 hex digits name the namespace)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))

    def of(h: Column) -> Column:
        variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
        part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

    return let(digest, of)


def chain_hash(record: Column, previous: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(record, previous), 256))


def stix_pattern(proto: Column, dst_ip: Column, dst_port: Column) -> Column:
    address = F.when(dst_ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.concat(F.lit("network-traffic:dst_ref.value = '"), dst_ip, F.lit("'")))
    port = F.when(dst_port != 0, F.concat(F.lit("network-traffic:dst_port = "), dst_port.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(" AND ", F.concat(F.lit("network-traffic:protocols[*] = '"), F.lower(proto), F.lit("'")), address, port), F.lit("]"))


def normalised_subtype(s: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
