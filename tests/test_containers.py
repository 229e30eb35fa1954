from lethe.operators import measure
from lethe.sources import containers


def boxed(spark, data):
    rows = containers.mbox(spark.createDataFrame([("in.mbox", bytearray(data))], "container string, data binary"))
    return [(r["path"], r["subject"], r["file_class"], bytes(r["data"])) for r in rows.orderBy("msg", "owner").collect()]


def test_mailbox(spark):
    got = boxed(spark, containers.sample_mbox())
    assert [(p, c) for p, _, c, _ in got] == [("in.mbox/msg/0/alice", "unique"), ("in.mbox/msg/1/bob", "unique"), ("in.mbox/msg/2", "mixed"), ("in.mbox/msg/2", "mixed"), ("in.mbox/msg/3/alice", "identical"), ("in.mbox/msg/4/bob", "identical")]


def test_odd_mail(spark):
    assert boxed(spark, b"") == [] and boxed(spark, b"From: Bob <b@x>\n\nhi") == [("in.mbox/msg/0/bob", "bob", "unique", b"hi")]
    multipart = b"From x\nSubject: s\nContent-Type: multipart/mixed; boundary=B\n\n--B\n\none\n--B\nContent-Transfer-Encoding: base64\n\ndHdv\n--B--\n"
    assert boxed(spark, multipart) == [("in.mbox/msg/0/unknown", "unknown", "unique", b"one\ntwo")]
    third = containers.sample_mbox() + b"From alice\nX-Backup-Subject: alice\n\nSetupProgram-same-bytes\n"
    assert [c for *_, c, d in boxed(spark, third) if d.startswith(b"Setup")] == ["identical"] * 3


def test_photos(spark, tmp_path):
    for name, data in (("alice-1.jpg", b"a"), ("bob-1.jpg", b"b"), ("group.jpg", b"g"), ("in/alice-bob.jpg", b"ab"), ("alice-x.jpg", b"x"), ("bob-x.jpg", b"x"), (".hidden", b"h"), ("tree.jpg", b"t"), ("_bob-2.jpg", b"u"), (".trip/bob 3, [x].jpg", b"v")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = containers.photos(containers.photo_files(spark, str(tmp_path))).collect()
    kinds = {(r["path"].removeprefix("photos/"), r["subject"]): r["file_class"] for r in got}
    both = {(n, who): "mixed" for n in ("group.jpg", "in/alice-bob.jpg") for who in ("alice", "bob")}
    assert kinds == both | {("alice-1.jpg", "alice"): "unique", ("bob-1.jpg", "bob"): "unique", ("alice-x.jpg", "alice"): "identical", ("bob-x.jpg", "bob"): "identical", ("tree.jpg", "alice"): "unique", ("_bob-2.jpg", "bob"): "unique", (".trip/bob 3, [x].jpg", "bob"): "unique"}


def test_erasure_inside_containers(spark):
    assert measure.containers_report(spark) == {"mbox_inner_bob_has_alice_lane": False, "mbox_whole_file_or_wrap_leaks": True, "photo_bob_has_alice_solo": False, "photo_bob_group_dropped": True}
