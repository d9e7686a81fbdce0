import json
from datetime import datetime
from email.message import EmailMessage

from pyspark.sql import functions as F

from corpuskiln.sources import chat, feeds, mail, notes
from corpuskiln.streaming import jobs


def write(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


def test_sync_folder(spark, tmp_path):
    folder = write(tmp_path, {
        "n1.md": "First\n\nBody ![p](:/" + "a" * 32 + ")\nmore\n\nid: n1\nparent_id: b1\ncreated_time: 2020\nupdated_time: 2021\nis_conflict: 0\ntype_: 1",
        "n2.md": "Empty\n\nid: n2\nparent_id: \ntype_: 1", "n3.md": "Secret\n\nx\n\nid: n3\nencryption_applied: 1\ntype_: 1",
        "b1.md": "Garden\n\nid: b1\nparent_id: \ntype_: 2", "t1.md": "rowing\n\nid: t1\ntype_: 5", "r1.md": "id: r1\nnote_id: n1\ntag_id: t1\ntype_: 6", "r2.md": "id: r2\nnote_id: n1\ntag_id: unknown\ntype_: 6", "z.md": "",
    })
    got = notes.parse_sync_folder(spark, folder).collect()
    assert [r.id for r in got] == ["n1", "n2"]
    a, b = got
    assert (a.title, a.notebook, a.tags, a.created_at, a.metadata, a.resource_links) == ("First", "Garden", ["rowing"], "2020", {"is_conflict": "0"}, ["a" * 32])
    assert a.body.endswith("more") and (b.body, b.notebook, b.tags) == ("", "", [])
    kinds = {r.kind: r.n for r in notes.census(notes.read_files(spark, folder)).collect()}
    assert kinds["1"] == 3 and kinds["6"] == 2


def test_front_matter_and_vault(spark, tmp_path):
    folder = write(tmp_path, {
        "a.md": "---\nid: x\ntitle: \"One\"\ntags: [a, b]\ncreated_time: 12\n---\nBody [[Link|here]]", "b.md": "no front", "c.md": "---\nnot yaml at all\n---\nrest",
        "v/d.md": "---\npublish: true\nmood: calm\ntags:\n- q\n- r\n---\n==lit==", "v/e.md": "---\npublish: maybe\n---\nx", ".hidden/f.md": "---\npublish: true\n---\nx",
    })
    got = {r.source_file.rsplit("/", 1)[1]: r for r in notes.parse_front_matter_folder(spark, folder).collect()}
    assert (got["a.md"].id, got["a.md"].title, got["a.md"].tags, got["a.md"].created_time) == ("x", "One", ["a", "b"], 12)
    assert got["b.md"].body == "no front" and got["c.md"].body.startswith("---")
    v = notes.parse_vault(spark, folder).collect()
    assert [(r.source_file, r.title, r.body, r.tags, r.metadata) for r in v] == [("v/d.md", "d", "lit", ["q", "r"], {"mood": "calm"})]
    assert v[0].id.startswith("obsidian::") and len(v[0].id) == 74


def test_chat_exports(spark, tmp_path):
    row = lambda **k: ",".join('"' + k.get(c, "").replace('"', '""') + '"' for c in chat.COLUMNS)
    head = ",".join(chat.COLUMNS)
    base = {"Chat Session": "Ann & Bo", "Message Date": "2030-01-01 10:00:00"}
    folder = write(tmp_path, {"one.csv": "\n".join([head, row(**base, Type="Incoming", **{"Sender Name": "Ann"}, Text='he said "hi"\nand left'), row(**base, Type="Outgoing", Text="ok"), row(**base, Type="Notification", Text="x"), row(**{"Message Date": "soon"}, Type="Incoming", Text="y")])})
    m = chat.read_exports(spark, folder, "Me")
    assert sorted((r.sender_name, r.text) for r in m.collect()) == [("Ann", 'he said "hi"\nand left'), ("Me", "ok")]
    t = chat.threads_of(m, "Me").collect()[0]
    assert (t.thread_type, t.message_count, t.privacy_tier, t.timestamp if "timestamp" in t else t.date_start) == ("bilateral", 2, 3, datetime(2030, 1, 1, 10))


def test_mbox(spark, tmp_path):
    mails = []
    for i, (sub, body) in enumerate([("Grüße", "Hallo\n> alt"), ("empty", ""), ("file", "see")]):
        m = EmailMessage()
        m["From"], m["To"], m["Subject"], m["Date"] = "Ann A <ann@x.test>", "me@x.test", sub, "Fri, 08 Nov 2024 14:28:17 -0500"
        if i != 2:
            m["Message-ID"] = f"<m{i}@x>"
        m["References"] = "<root@x> <m9@x>"
        m.set_content(body)
        if i == 2:
            m.add_attachment(b"abc", maintype="image", subtype="png", filename="p.png")
        mails.append("From ann Fri\n" + m.as_string())
    folder = write(tmp_path, {"a.mbox": "\n".join(mails)})
    got = {r.subject: r for r in mail.read_mbox(spark, folder, ["me@x.test"]).collect()}
    assert set(got) == {"Grüße", "file"}
    g = got["Grüße"]
    assert (g.message_id, g.from_addr, g.from_name, g.stripped_body, g.thread_root, g.direction, str(g.date)) == ("<m0@x>", "ann@x.test", "Ann A", "Hallo", "<root@x>", "received", "2024-11-08 19:28:17")
    assert got["file"].message_id.endswith("@local>") and got["file"].attachments[0].size == 3


def test_feeds(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "j").mkdir()
    write(tmp_path / "r", {"blog.xml": "<rss><channel><item><title>T &amp; U</title><link>http://x/1</link><description>&lt;b&gt;s&lt;/b&gt;</description><pubDate>Fri, 08 Nov 2024 14:28:17 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"})
    got = feeds.read_rss(spark, str(tmp_path / "r")).collect()
    assert [(r.source, r.title, r.summary, str(r.published), len(r.item_hash)) for r in got] == [("blog", "T & U", "s", "2024-11-08 14:28:17", 16)]
    write(tmp_path / "j", {"n.json": json.dumps({"articles": [{"title": "A", "url": "u", "description": "d", "publishedAt": "2024-01-01T00:00:00Z", "source": {"name": "S"}}, {"title": "[Removed]", "url": "v"}]})})
    assert [r.title for r in feeds.read_news(spark, str(tmp_path / "j")).collect()] == ["A"]


def test_streams(spark, tmp_path):
    rows = [("u", "a", "2020-01-01 00:00:00", "x"), ("u", "a", "2020-01-01 00:00:00", "x"), ("u", "b", "2020-01-01 03:00:00", "x"), ("u", "c", "2020-01-01 09:00:00", "y"), ("u", "d", "2020-02-01 00:00:00", "y")]
    df = spark.createDataFrame(rows, "user string, id string, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.n for r in run(jobs.streaming_bursts(stream(), "user", "ts"), "bursts")) == [1, 3]
    assert len(run(jobs.once_within(stream(), "id", "ts"), "once")) == 4
    assert sum(r.n for r in run(jobs.tumbling_counts(stream(), "ts", "kind"), "days")) == 4
    got = []
    body = stream().select("id", F.col("kind").alias("body"), F.lit(None).cast("array<float>").alias("embedding"))
    q = jobs.backfill(body, lambda c: F.array(F.length(c).cast("float")), lambda b, no: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "fill")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) == 5 and got[0].embedding == [1.0]
