"""How much work the reading of mails takes: headers are taken apart once, and what a task holds is bounded."""

from __future__ import annotations

from email import headerregistry, policy
from email.message import EmailMessage
from email.parser import BytesParser

import pyarrow as pa
from tessera.sources import mail


class Frame:
    """Hands out the function that a plan would run."""

    dtypes = [("path", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def letter(subject, *attached):
    m = EmailMessage()
    m["From"], m["Subject"], m["To"] = f"{subject}@intranet", subject, ", ".join(f"Person {i} <p{i}@far.example>" for i in range(60))
    m.set_content(f"Words of {subject}.")
    m.add_attachment(b"a note", maintype="application", subtype="octet-stream", filename="note.bin")
    for a in attached:
        m.add_attachment(a)
    return m


def read(*contents):
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(contents))]), pa.array(contents, pa.binary())], ["path", "content"])
    return list(mail.parsed(Frame(), "path", "content")(iter([batch])))


def test_headers_are_taken_apart_once(monkeypatch):
    whole = letter("one", letter("two", letter("three"), letter("four")))
    headers = sum(len(m.keys()) for m in whole.walk())
    seen, real = [], headerregistry.HeaderRegistry.__call__
    raw = bytes(whole)
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda self, name, value: seen.append(name) or real(self, name, value))
    row = read(raw)[0].to_pylist()[0]
    assert len(seen) <= headers
    plain = BytesParser(policy=policy.default).parsebytes(raw)
    assert (row["subject"], row["sender"], row["body"]) == ("one", "one@intranet", "Words of one.\n")
    assert [a["content"] for a in row["attachments"]] == [a.get_content().as_bytes() if a.get_content_type() == "message/rfc822" else a.get_payload(decode=True) for a in plain.iter_attachments()]
    assert [a["name"] for a in row["attachments"]] == ["note.bin", "two.eml"]


def test_long_headers_are_read_too():
    m = letter("x")
    del m["Subject"]
    m["Subject"] = "word " * 200 + "end"
    assert read(bytes(m))[0].to_pylist()[0]["subject"] == "word " * 200 + "end"


def test_few_mails_are_held_at_a_time():
    big = EmailMessage()
    big["Subject"] = "big"
    big.set_content("w" * 70 + "\n")
    big.add_attachment(b"x" * 600_000, maintype="application", subtype="octet-stream", filename="x.bin")
    assert [b.num_rows for b in read(*[bytes(big)] * 4)] == [1, 1, 1, 1]
