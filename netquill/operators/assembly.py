"""Packets to flows, events and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.functions.codes import code_name
from netquill.functions.net import bucket, flow_uid, sender_is_originator
from netquill.operators.sequential import split_lifetimes

# fixed values: vendor default logins (for comparison only), compilers and paths that take code
DEFAULT_LOGINS = (
    "tomcat:tomcat", "tomcat:s3cret", "tomcat:admin", "admin:tomcat", "admin:admin", "admin:password", "admin:", "admin:1234", "admin:12345", "root:root",
    "root:toor", "root:password", "manager:manager", "role1:role1", "both:tomcat", "guest:guest", "cisco:cisco", "user:user", "test:test",
)
COMPILERS = ("gcc", "g++", "cc", "c++", "cpp", "clang", "clang++", "as", "ld", "cc1", "cc1plus")
COMPILER_ENDINGS = ("-gcc", "-g++")
COMPILER_BEGINNINGS = ("gcc-", "g++-", "clang-")
DEPLOY_BEGINNINGS = ("/manager/html/upload", "/manager/text/deploy", "/manager/html/deploy")
DEPLOY_PATHS = ("/manager/deploy", "/script", "/scripttext")
MAIL_PORTS = (25, 587, 2525)


def direction_free(packets: DataFrame) -> DataFrame:
    """Packets with their endpoints in an order of their own, and whether they go from the first to the second; no DNS replies."""
    end = lambda a, p: F.struct(F.col(a).alias("ip"), F.coalesce(F.col(p), F.lit(0)).alias("port"))
    rows = packets.where(F.coalesce("dns_qr", F.lit(0)) == 0) if "dns_qr" in packets.columns else packets
    a, b = end("src", "sport"), end("dst", "dport")
    return rows.withColumns({"a": F.least(a, b), "b": F.greatest(a, b), "proto": F.upper("proto"), "forward": a <= b})


def _flows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate packets of each key; who originates is decided by the first packet."""
    first = lambda x: F.min_by(x, F.struct("ts", "id"))
    a_starts = F.col("forward") == sender_is_originator(F.col("proto"), F.col("sport"), F.col("dport"), F.col("tcp_flags"))
    size = F.coalesce("wire_len", F.lit(0)).cast("bigint")
    made = rows.groupBy(*keys).agg(
        F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), first(a_starts).alias("a_starts"), F.count("*").alias("pkts"),
        F.sum(F.when(F.col("forward"), size).otherwise(0)).alias("ab_bytes"), F.sum(F.when(~F.col("forward"), size).otherwise(0)).alias("ba_bytes"),
        F.count_if(F.col("forward")).alias("ab_pkts"), F.count_if(~F.col("forward")).alias("ba_pkts"),
    )
    return oriented(made, [k for k in keys if k not in ("a", "b")])


def oriented(made: DataFrame, keep: list[str]) -> DataFrame:
    """Flows between ``a`` and ``b`` seen from their originator."""
    side = lambda x, y: F.when(F.col("a_starts"), F.col(x)).otherwise(F.col(y))
    out = made.select(
        *keep, "ts", "last_ts", (F.col("last_ts") - F.col("ts")).alias("duration_s"),
        side("a.ip", "b.ip").alias("src_ip"), side("a.port", "b.port").alias("src_port"), side("b.ip", "a.ip").alias("dst_ip"), side("b.port", "a.port").alias("dst_port"),
        side("ab_bytes", "ba_bytes").alias("orig_bytes"), side("ba_bytes", "ab_bytes").alias("resp_bytes"),
        side("ab_pkts", "ba_pkts").alias("orig_pkts"), side("ba_pkts", "ab_pkts").alias("resp_pkts"),
    )
    name = lambda x: F.concat_ws(":", f"{x}_ip", f"{x}_port")
    return out.withColumn("flow_uid", flow_uid(name("src"), name("dst"), F.col("proto")))


def assemble_flows(packets: DataFrame) -> DataFrame:
    """One flow for each capture, pair of endpoints and protocol; DNS replies aren't folded in."""
    return _flows(direction_free(packets), ["capture_id", "proto", "a", "b"])


def _sessions(packets: DataFrame, idle: float) -> DataFrame:
    keys = ["capture_id", "proto", "a", "b"]
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    rows = direction_free(packets)
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(w) > idle).cast("int"), F.lit(0))
    return rows.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def assemble_live(packets: DataFrame, idle: float = 60, hard: float = 300) -> DataFrame:
    """Flows that end after ``idle`` seconds without a packet or ``hard`` seconds of life."""
    keys = ["capture_id", "proto", "a", "b", "session"]
    return _flows(split_lifetimes(_sessions(packets, idle), keys, "ts", hard), [*keys, "part"])


def flow_snapshots(packets: DataFrame, every: float = 2) -> DataFrame:
    """Each flow so far, seen from its originator, at the end of every tick in which it changed.

    Packets are added up by tick before the window, so a flow's window holds a row for each tick."""
    rows = direction_free(packets).withColumn("tick", bucket(F.col("ts"), every))
    size, there = F.coalesce("wire_len", F.lit(0)).cast("bigint"), F.col("forward")
    keys = ["capture_id", "proto", "a", "b"]
    starts = F.col("forward") == sender_is_originator(F.col("proto"), F.col("sport"), F.col("dport"), F.col("tcp_flags"))
    ticks = rows.groupBy(*keys, "tick").agg(
        F.sum(F.when(there, size).otherwise(0)).alias("ab_bytes"), F.sum(F.when(~there, size).otherwise(0)).alias("ba_bytes"),
        F.count_if(there).alias("ab_pkts"), F.count_if(~there).alias("ba_pkts"), F.min("ts").alias("t_"), F.max("ts").alias("u_"),
        F.struct(F.min_by(starts, F.struct("ts", "id")).alias("x")).alias("starts"),
    )
    so_far = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    made = ticks.select(
        *keys, "tick", F.min("t_").over(so_far).alias("ts"), F.max("u_").over(so_far).alias("last_ts"), F.first("starts").over(so_far)["x"].alias("a_starts"),
        *[F.sum(c).over(so_far).alias(c) for c in ("ab_bytes", "ba_bytes", "ab_pkts", "ba_pkts")],
    )
    total = {"total_bytes": F.col("ab_bytes") + F.col("ba_bytes"), "total_pkts": F.col("ab_pkts") + F.col("ba_pkts")}
    return oriented(made.withColumns(total), [*keys, "tick", *total])


#: detectors of running flows and of ended ones
PHASES = {"snapshot": ("flood", "recon", "brute_force"), "ended": ("flood", "beacons", "recon", "exfiltration", "brute_force")}


def route_phases(flows: DataFrame, phase: str = "phase") -> dict[str, DataFrame]:
    """The flows each detector gets, by the ``phase`` column (snapshot or ended)."""
    return {d: flows.where(F.col(phase).isin(*[p for p, ds in PHASES.items() if d in ds])) for d in sorted({d for ds in PHASES.values() for d in ds})}


def _job_arguments(text: Column) -> Column:
    """The arguments of a compile job, cut by the lengths that precede them; null where there is no whole first argument.

    ``text`` has a character for each byte."""
    hexadecimal = lambda x: F.conv(x, 16, 10).cast("bigint")
    size = F.lit("^[0-9a-fA-F]{8}$")
    head = (F.substring(text, 1, 4) == "DIST") & (F.substring(text, 13, 4) == "ARGC") & F.substring(text, 5, 8).rlike("^[0-9a-fA-F]{8}$") & F.substring(text, 17, 8).rlike("^[0-9a-fA-F]{8}$")
    count = F.when(head, F.least(hexadecimal(F.substring(text, 17, 8)), F.lit(64))).otherwise(0).cast("int")

    def cut(state: Column, _: Column) -> Column:
        at, mark = state["at"], F.substring(text, state["at"], F.lit(4))
        digits = F.substring(text, at + 4, F.lit(8))
        more = (state["state"] == 0) & (mark == "ARGV") & (F.length(digits) == 8)
        plain = F.regexp_like(digits, size)
        n = F.when(plain, hexadecimal(digits)).otherwise(0)
        short = (F.size(state["found"]) == 0) & (at - 1 + 12 + n > F.length(text))
        own = F.decode(F.encode(F.substring(text, at + 12, F.least(n, F.lit(160)).cast("int")), "ISO-8859-1"), "UTF-8")
        clean = F.trim(F.regexp_replace(own, "[\\x00-\\x1f\\x7f]", ""))
        ahead = F.least(at + 12 + n, F.lit(1 << 30)).cast("int")
        fine = F.struct(ahead.alias("at"), F.concat(state["found"], F.array(clean)).alias("found"), F.lit(0).alias("state"))
        ended = lambda code: F.struct(at.alias("at"), state["found"].alias("found"), (F.lit(code) if isinstance(code, int) else code).alias("state"))
        return F.when(~more, ended(F.greatest(state["state"], F.lit(1)))).when(~plain | short, ended(2)).otherwise(fine)

    start = F.struct(F.lit(25).alias("at"), F.array().cast("array<string>").alias("found"), F.lit(0).alias("state"))
    turns = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, cut, lambda s: F.when((s["state"] < 2) & (F.size(s["found"]) > 0), s["found"]))


def app_events(packets: DataFrame) -> DataFrame:
    """Application events from plain payloads: SMTP probes and refusals, HTTP logins, refusals and deployments, compile jobs.

    Passwords are compared, never kept.
    """
    text = F.decode(F.coalesce("payload", F.lit(b"")), "ISO-8859-1")
    rows = packets.withColumn("text", text)
    verb = r"(?i)^(VRFY |EXPN |RCPT TO:)\s*<?([^\s>@]*)[^\n]{0,280}\n$"
    smtp, account = F.upper(F.trim(F.regexp_extract("text", verb, 1))), F.regexp_extract("text", verb, 2)
    request = r"^(?:GET|POST|PUT|HEAD|DELETE) (\S+) HTTP/1\."
    path = F.regexp_extract("text", request, 1)
    login = F.when(path != "", F.regexp_extract("text", r"(?im)^Authorization: *Basic +([A-Za-z0-9+/]+)", 1)).otherwise("")
    padded = F.concat(login, F.repeat(F.lit("="), F.pmod(-F.length(login), F.lit(4))))
    pair = F.when(login != "", F.try_to_binary(padded, F.lit("base64")).cast("string"))
    default = F.coalesce(pair.isin(*DEFAULT_LOGINS), F.lit(False))
    target = F.lower(F.substring_index(path, "?", 1))
    takes_code = target.isin(*DEPLOY_PATHS)
    for beginning in DEPLOY_BEGINNINGS:
        takes_code |= target.startswith(beginning)
    deploy = F.col("text").rlike("^(POST|PUT) ") & takes_code
    arguments = F.when(F.col("text").startswith("DIST"), _job_arguments(F.col("text")))
    job = F.lower(F.substring_index(arguments[0], "/", -1))
    compiler = job.isin(*COMPILERS)
    for ending in COMPILER_ENDINGS:
        compiler |= job.endswith(ending)
    for beginning in COMPILER_BEGINNINGS:
        compiler |= job.startswith(beginning)
    event = lambda ok, f, d, c: F.when(ok, F.struct(f.alias("app_function"), d.alias("app_detail"), c.cast("int").alias("app_code")))
    none = F.lit("")
    mail = F.when(smtp == "VRFY", "smtp_vrfy").when(smtp == "EXPN", "smtp_expn").otherwise("smtp_rcpt")
    refusal = F.regexp_extract("text", r"^(55[0-9])[ -]", 1)
    events = F.array_compact(F.array(
        event(smtp != "", mail, account, F.lit(0)),
        event((refusal != "") & F.col("sport").isin(*MAIL_PORTS), F.lit("smtp_reject"), none, refusal.try_cast("int")),
        event(deploy, F.lit("http_admin_deploy"), F.substring(path, 1, 96), F.when(default, 3).otherwise(1)),
        event(~deploy & pair.isNotNull(), F.lit("http_basic"), F.substring(F.substring_index(pair, ":", 1), 1, 64), default),
        event(F.col("text").rlike(r"^HTTP/1\.. 401"), F.lit("http_401"), none, F.lit(401)),
        event(arguments.isNotNull(), F.concat(F.lit("distcc:"), job), F.substring(F.array_join(F.slice(arguments, 2, 5), " "), 1, 160), ~compiler),
    ))
    sender = F.col("e.app_function").isin("smtp_reject", "http_401")  # sent by the server
    side = lambda x, y: F.when(sender, F.col(x)).otherwise(F.col(y))
    return rows.select("capture_id", "id", "ts", "src", "dst", "sport", "dport", F.explode(events).alias("e")).select(
        "capture_id", F.col("id").alias("rid"), "ts", side("dst", "src").alias("src_ip"), side("dport", "sport").alias("src_port"),
        side("src", "dst").alias("dst_ip"), side("sport", "dport").alias("dst_port"), "e.*",
    )


def http_requests(packets: DataFrame) -> DataFrame:
    """The first HTTP/1 request of each direction of a flow: method, uri, user agent, content length."""
    text = F.decode(F.coalesce("payload", F.lit(b"")), "ISO-8859-1")
    line = r"^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|CONNECT|TRACE) (\S+) HTTP/1\.[01]"
    rows = packets.withColumn("text", text).where(F.col("text").rlike(line))
    first = F.row_number().over(Window.partitionBy("capture_id", "src", "sport", "dst", "dport").orderBy("ts", "id"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.select(
        "capture_id", "id", "ts", "src", "sport", "dst", "dport", F.regexp_extract("text", line, 1).alias("method"), F.regexp_extract("text", line, 2).alias("uri"),
        F.trim(F.regexp_extract("text", r"(?im)^User-Agent:([^\r\n]*)", 1)).alias("user_agent"),
        F.coalesce(F.regexp_extract("text", r"(?im)^Content-Length:\s*(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("request_body_len"),
    )


def ot_fixed_decode(packets: DataFrame) -> DataFrame:
    """Function names from fixed places of Modbus (port 502) and DNP3 (port 20000) requests."""
    byte = lambda i: F.conv(F.hex(F.substring("payload", i + 1, 1)), 16, 10).cast("int")
    modbus = (F.col("dport") == 502) & (F.length("payload") >= 8) & (byte(2) == 0) & (byte(3) == 0)
    dnp3 = (F.col("dport") == 20000) & (F.length("payload") >= 13) & (F.hex(F.substring("payload", 1, 2)) == "0564")
    rows = packets.withColumn("protocol", F.when(modbus, "modbus").when(dnp3, "dnp3")).where("protocol is not null")
    name = F.when(F.col("protocol") == "modbus", code_name(byte(7), "modbus")).otherwise(code_name(byte(12), "dnp3"))
    register = F.when((F.col("protocol") == "modbus") & (F.length("payload") >= 10), byte(8) * 256 + byte(9))
    return rows.select("capture_id", "id", "ts", "src", "sport", "dst", "dport", "protocol", name.alias("function"), register.alias("register"))


def ja4(hello: DataFrame) -> DataFrame:
    """Adds ``ja4`` to parsed TLS client hellos: ``transport`` (t or q), ``versions``, ``ciphers``, ``extensions``, ``sig_algs``
    (arrays of int), ``alpn`` (string), ``has_sni``."""
    grease = lambda x: (x.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(0xFF))
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda x: ~grease(x))
    hexed = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ",")
    short = lambda s: F.when(s == "", F.lit("000000000000")).otherwise(F.substring(F.sha2(s, 256), 1, 12))
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    top, ciphers, exts = F.array_max(clean(F.col("versions"))), clean(F.col("ciphers")), clean(F.col("extensions"))
    version = F.when(top == 0x0304, "13").when(top == 0x0303, "12").when(top == 0x0302, "11").when(top == 0x0301, "10").when(top == 0x0300, "s3").otherwise("00")
    alpn = F.coalesce("alpn", F.lit(""))
    ends = F.when(alpn == "", "00").otherwise(F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1)))
    first = F.concat(F.col("transport"), version, F.when(F.col("has_sni"), "d").otherwise("i"), two(F.size(ciphers)), two(F.size(exts)), ends)
    kept = F.array_sort(F.filter(exts, lambda x: ~x.isin(0x0000, 0x0010)))
    algs = hexed(clean(F.col("sig_algs")))
    third = F.concat(hexed(kept), F.when((algs != "") & (F.size(kept) > 0), F.concat(F.lit("_"), algs)).otherwise(""))
    return hello.withColumn("ja4", F.concat_ws("_", first, short(hexed(F.array_sort(ciphers))), short(third)))
