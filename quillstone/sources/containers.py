"""Container snapshots: scans of daemon documents (JSON rows) into flat rows, statistics and compose listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import cpu_percent, memory_percent
from ..registry import Registry
from ..views import table

R = Registry()

PORTS = "map<string,array<struct<HostIp:string,HostPort:string>>>"
CONTAINER = f"struct<Id:string,Name:string,Tags:array<string>,Config:struct<Image:string,Env:array<string>,Cmd:array<string>,Labels:map<string,string>>,State:struct<Status:string,Running:boolean,ExitCode:int>,Created:string,NetworkSettings:struct<Ports:{PORTS},Networks:map<string,struct<NetworkID:string,IPAddress:string>>>,Mounts:array<struct<Type:string,Source:string,Destination:string>>,HostConfig:struct<Memory:bigint,NanoCpus:bigint>>"
IMAGE = "struct<Id:string,RepoTags:array<string>,Size:bigint,Created:string>"
NETWORK = "struct<Id:string,Name:string,Driver:string,IPAM:struct<Config:array<struct<Subnet:string,Gateway:string>>>,Containers:map<string,struct<Name:string,IPv4Address:string>>>"
VOLUME = "struct<Name:string,Driver:string,Mountpoint:string,CreatedAt:string,Labels:map<string,string>>"
SERVICE = "struct<Name:string,Service:string,State:string,Status:string,Publishers:array<struct<PublishedPort:int,TargetPort:int>>,Ports:string>"
STATS = "struct<cpu_stats:struct<cpu_usage:struct<total_usage:bigint>,system_cpu_usage:bigint,online_cpus:int>,precpu_stats:struct<cpu_usage:struct<total_usage:bigint>,system_cpu_usage:bigint>,memory_stats:struct<usage:bigint,`limit`:bigint>>"


def parsed(rows: DataFrame, json_col: str, schema: str, key: str) -> DataFrame:
    """rows whose JSON parses and names its `key`; others are skipped. The value is in column `d`."""
    return rows.withColumn("d", F.from_json(json_col, schema)).where(F.col(f"d.{key}").isNotNull())


def containers(rows: DataFrame, json_col: str = "doc") -> DataFrame:
    """(id, name, image, status, ports, created): image by its first tag, else by configuration; a port by its first binding."""
    d = parsed(rows, json_col, CONTAINER, "Id")
    ports = F.transform_values(F.map_filter("d.NetworkSettings.Ports", lambda k, v: F.size(v) > 0), lambda k, v: F.get(v, F.lit(0))["HostPort"])
    return d.select(
        F.col("d.Id").alias("id"),
        F.regexp_replace("d.Name", "^/", "").alias("name"),
        F.coalesce(F.get("d.Tags", F.lit(0)), F.col("d.Config.Image"), F.lit("unknown")).alias("image"),
        F.coalesce("d.State.Status", F.lit("unknown")).alias("status"),
        F.coalesce(ports, F.create_map().cast("map<string,string>")).alias("ports"),
        F.col("d.Created").alias("created"),
    )


def inspected(rows: DataFrame, json_col: str = "doc") -> DataFrame:
    """One flat row per container, with all bindings of its ports, its networks (ids cut to 12) and its mounts."""
    d = parsed(rows, json_col, CONTAINER, "Id")
    networks = F.transform_values("d.NetworkSettings.Networks", lambda k, v: F.struct(F.left(v["NetworkID"], F.lit(12)).alias("network_id"), F.coalesce(v["IPAddress"], F.lit("")).alias("ip")))
    return d.select(
        F.col("d.Id").alias("id"),
        F.regexp_replace("d.Name", "^/", "").alias("name"),
        F.coalesce("d.Config.Env", F.array()).alias("env"),
        F.array_join(F.coalesce("d.Config.Cmd", F.array()), " ").alias("command"),
        F.coalesce("d.Config.Labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.coalesce("d.State.Running", F.lit(False)).alias("running"),
        F.coalesce("d.State.ExitCode", F.lit(0)).alias("exit_code"),
        F.col("d.NetworkSettings.Ports").alias("ports"),
        networks.alias("networks"),
        F.coalesce("d.Mounts", F.array()).alias("mounts"),
        F.coalesce("d.HostConfig.Memory", F.lit(0)).alias("memory_limit"),
        F.coalesce("d.HostConfig.NanoCpus", F.lit(0)).alias("nano_cpus"),
    )


def images(rows: DataFrame, json_col: str = "doc") -> DataFrame:
    """(id, repository, tag, size, created): the first tag split at its first colon, `<none>` without one; MB with two decimals."""
    d = parsed(rows, json_col, IMAGE, "Id")
    tag = F.coalesce(F.get("d.RepoTags", F.lit(0)), F.lit("<none>:<none>"))
    return d.select(
        F.col("d.Id").alias("id"),
        F.split(tag, ":", 2)[0].alias("repository"),
        F.coalesce(F.get(F.split(tag, ":", 2), F.lit(1)), F.lit("<none>")).alias("tag"),
        F.format_string("%.2f MB", F.col("d.Size") / 1048576.0).alias("size"),
        F.split("d.Created", "T")[0].alias("created"),
    )


def networks(rows: DataFrame, json_col: str = "doc") -> DataFrame:
    d = parsed(rows, json_col, NETWORK, "Id")
    first = F.get("d.IPAM.Config", F.lit(0))
    return d.select(F.left("d.Id", F.lit(12)).alias("id"), F.col("d.Name").alias("name"), F.col("d.Driver").alias("driver"), first["Subnet"].alias("subnet"), first["Gateway"].alias("gateway"), F.coalesce(F.size("d.Containers"), F.lit(0)).alias("container_count"), "d.Containers")


def volumes(rows: DataFrame, json_col: str = "doc") -> DataFrame:
    d = parsed(rows, json_col, VOLUME, "Name")
    return d.select(F.col("d.Name").alias("name"), F.coalesce("d.Driver", F.lit("local")).alias("driver"), F.col("d.Mountpoint").alias("mountpoint"), F.col("d.CreatedAt").alias("created"), F.coalesce("d.Labels", F.create_map().cast("map<string,string>")).alias("labels"))


def compose_services(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(name, status, ports) of listings in which a line is an object or an array of them; malformed lines are skipped."""
    many = F.from_json(line_col, f"array<{SERVICE}>")
    single = F.from_json(line_col, SERVICE)
    both = F.when(F.trim(line_col).startswith("["), many).otherwise(F.array(single))
    s = lines.select("*", F.explode(F.filter(both, lambda x: x["Name"].isNotNull() | x["Service"].isNotNull())).alias("s"))
    published = F.array_join(F.transform("s.Publishers", lambda p: F.concat(p["PublishedPort"], F.lit("->"), p["TargetPort"])), ",")
    return s.select(*lines.columns, F.coalesce("s.Name", "s.Service").alias("name"), F.coalesce("s.State", "s.Status").alias("status"), F.coalesce(published, "s.Ports", F.lit("")).alias("ports")).drop(line_col)


def sample_stats(rows: DataFrame, id_col: str, json_col: str = "doc") -> DataFrame:
    """(id, cpu_percent, memory_percent) of statistics samples; rows that do not parse are dropped."""
    d = parsed(rows, json_col, STATS, "cpu_stats")
    used = F.col("d.cpu_stats.cpu_usage.total_usage") - F.col("d.precpu_stats.cpu_usage.total_usage")
    system = F.col("d.cpu_stats.system_cpu_usage") - F.col("d.precpu_stats.system_cpu_usage")
    memory = memory_percent(F.coalesce("d.memory_stats.usage", F.lit(0)), F.coalesce(F.col("d.memory_stats.limit"), F.lit(0)))
    return d.select(id_col, F.coalesce(cpu_percent(used, system, F.col("d.cpu_stats.online_cpus")), F.lit(0.0)).alias("cpu_percent"), memory.alias("memory_percent"))


def daemon_status(containers_: DataFrame, images_: DataFrame, version: str, api_version: str) -> DataFrame:
    """One row: versions, containers running and in all, images; the images are counted in a scalar subquery."""
    c = containers_.agg(F.count_if(F.col("status") == "running").alias("running"), F.count("*").alias("total"))
    return c.withColumn("images", images_.agg(F.count("*")).scalar()).select(F.lit(True).alias("connected"), F.lit(version).alias("version"), F.lit(api_version).alias("api_version"), "running", "total", "images")


# --- Queries over documents made from the tables ----------------------------------------------------------------


def _json(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _container_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tags = F.when(k % 3 == 0, F.lit("[]")).otherwise(_json('["app:', k, '"]'))
    good = _json('{"Id":"', F.md5(k.cast("string")), '","Name":"/', F.col("c_name"), '","Tags":', tags, ',"Config":{"Image":"base:', k % 7, '"},"State":{"Status":"', F.when(k % 2 == 0, "running").otherwise("exited"), '"},"Created":"2024-01-01T00:00:00","NetworkSettings":{"Ports":{"80/tcp":[{"HostIp":"0.0.0.0","HostPort":"', k % 1000 + 8000, '"}],"443/tcp":null},"Networks":{"bridge":{"NetworkID":"', F.sha2(k.cast("string"), 256), '"}}}}')
    return c.select("c_custkey", F.when(k % 11 == 0, F.lit("{broken")).otherwise(good).alias("doc"))


@R.query("container_list", """SELECT md5(CAST(c_custkey AS VARCHAR)) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'base:' || c_custkey % 7 ELSE 'app:' || c_custkey END AS image, CASE WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'exited' END AS status, CAST(c_custkey % 1000 + 8000 AS VARCHAR) AS port FROM customer WHERE c_custkey % 11 <> 0""")
def container_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(_container_docs(spark, sf_dir)).select("id", "name", "image", "status", F.try_element_at("ports", F.lit("80/tcp")).alias("port"))


@R.query("container_inspect", """SELECT md5(CAST(c_custkey AS VARCHAR)) AS id, left(sha256(CAST(c_custkey AS VARCHAR)), 12) AS network_id, CAST(0 AS BIGINT) AS memory_limit, false AS running, CAST(2 AS INTEGER) AS n_ports FROM customer WHERE c_custkey % 11 <> 0""")
def container_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspected(_container_docs(spark, sf_dir)).select("id", F.col("networks")["bridge"]["network_id"].alias("network_id"), "memory_limit", "running", F.size("ports").alias("n_ports"))


def _image_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tags = F.when(k % 5 == 0, F.lit("null")).otherwise(_json('["repo', k % 9, ":v", k, ':x"]'))
    return table(spark, sf_dir, "part").select(_json('{"Id":"i', k, '","RepoTags":', tags, ',"Size":', k * 1048576 + 524288, ',"Created":"2024-02-0', k % 9 + 1, 'T10:00:00"}').alias("doc"))


@R.query("image_list", """SELECT 'i' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '<none>' ELSE 'repo' || p_partkey % 9 END AS repository, CASE WHEN p_partkey % 5 = 0 THEN '<none>' ELSE 'v' || p_partkey || ':x' END AS tag, p_partkey || '.50 MB' AS size, '2024-02-0' || (p_partkey % 9 + 1) AS created FROM part""")
def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(_image_docs(spark, sf_dir))


@R.query("network_list", """SELECT 'net' || s_suppkey AS name, '10.' || s_suppkey % 200 || '.0.0/16' AS subnet, CAST(s_suppkey % 2 + 1 AS INTEGER) AS container_count FROM supplier""")
def network_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    attached = F.when(k % 2 == 1, '{"a":{"Name":"x"},"b":{"Name":"y"}}').otherwise('{"a":{"Name":"x"}}')
    docs = table(spark, sf_dir, "supplier").select(_json('{"Id":"0123456789abcdef', k, '","Name":"net', k, '","Driver":"bridge","IPAM":{"Config":[{"Subnet":"10.', k % 200, '.0.0/16","Gateway":"10.0.0.1"}]},"Containers":', attached, "}").alias("doc"))
    return networks(docs).select("name", "subnet", "container_count")


@R.query("volume_list", """SELECT 'v' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'nfs' ELSE 'local' END AS driver, '/data/' || n_name AS mountpoint FROM nation""")
def volume_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    driver = F.when(k % 2 == 0, ',"Driver":"nfs"').otherwise("")
    docs = table(spark, sf_dir, "nation").select(_json('{"Name":"v', k, '"', driver, ',"Mountpoint":"/data/', F.col("n_name"), '"}').alias("doc"))
    return volumes(docs).select("name", "driver", "mountpoint")


@R.query("compose_services", """SELECT n_nationkey AS k, 's' || n_nationkey AS name, 'running' AS status, '80' || n_nationkey || '->80' AS ports FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, 't' || n_nationkey, 'up', '' FROM nation WHERE n_nationkey % 3 = 1""")
def compose_services_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    one = _json('{"Name":"s', k, '","State":"running","Publishers":[{"PublishedPort":80', k, ',"TargetPort":80}]}')
    line = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat(F.lit("["), one, _json(',{"Service":"t', k, '","Status":"up"}]'))).otherwise("{oops")
    return compose_services(table(spark, sf_dir, "nation").select(k.alias("k"), line.alias("line")))


@R.query("container_stats", """SELECT c_custkey AS id, round(CASE WHEN c_custkey % 50 > 0 THEN (c_custkey % 50) / 1000 * 2 * 100.0 ELSE 0 END, 2) AS cpu_percent, round((c_custkey % 77) / 200 * 100.0, 2) AS memory_percent FROM customer""")
def container_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    doc = _json('{"cpu_stats":{"cpu_usage":{"total_usage":', k % 50 + 100, '},"system_cpu_usage":2000,"online_cpus":2},"precpu_stats":{"cpu_usage":{"total_usage":100},"system_cpu_usage":1000},"memory_stats":{"usage":', k % 77, ',"limit":200}}')
    return sample_stats(table(spark, sf_dir, "customer").select(k.alias("id"), doc.alias("doc")), "id")


@R.query("daemon_status", """SELECT true AS connected, '27.0' AS version, '1.46' AS api_version, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 2 = 0) AS running, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0) AS total, (SELECT count(*) FROM part) AS images""")
def daemon_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daemon_status(containers(_container_docs(spark, sf_dir)), images(_image_docs(spark, sf_dir)), "27.0", "1.46")
