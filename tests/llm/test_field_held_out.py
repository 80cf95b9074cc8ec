"""The field on labelled lines that it was not trained on, and the labelled table against the documents."""

import re

from preflux.llm import pii

HELD_OUT = """
reply to [email|nora.w@harbor.example] by friday
bitte an [email|max_m@werk2.example.de], danke
courriel [email|paul(at)mairie.example.fr] svp
correo de [email|ana[at]tienda.example.es] aqui
you can reach [email|desk(at)hotel.example.com] any time
forward it to [email|r.jones[at]clinic.example.org] please
login as [email|root@mailhost] then
or [email|zoe+news@list.example.net].
the router [ip|10.20.30.40] rebooted
a scan from [ip|203.0.113.9]:8443 began
routes for [ip|198.51.100.0]/25 changed
bad address [ip|192.0.2.310] in line
from [ip|172.31.9.77], twice
host [ip|10.9.8.7]:22 refused
Zugriff von [ip|192.168.7.301] gesperrt
my card [card|4000 5600 1234 7711] was lost
paid by [card|5105-1051-0510-5119] today
charged [card|6212345678901233] twice
carte [card|4970 1012 3456 7891] refusée
mit [card|5610591081018251] bezahlt
number [card|3782-8224-6310-0055] is wrong
tarjeta [card|8431077712906354] nueva
use [card|9102837465564738] instead
the [card|7310294857610293] was stolen
ring [phone|(415) 555-0123] tonight
call [phone|1-888-555-0199] free
tel [phone|020 7946 0123] or email
Telefon [phone|030-5550177], bitte
fax [phone|+49 40 5550 188] nur
phone [phone|555-0134-778] after noon
mobile [phone|0176 5550 1234] now
dial [phone|+1 (702) 555-0168] and hold
his number is [phone|0131 496 0456].
tél [phone|04 55 50 17 83] le soir
in 1995 and again in 2014
commit 4be1d9a07c53f2286ab91e50d7c4f8a3b6e2019d broke it
secret = "77aa01bc93de42f5608812cd" stays
version 4.2.1 came in 2020
costs 24.50 or 3,000 a year
chapter 3 of 12 has 400 pages
at 09:15 on 2023-11-05
only 12% of 3400 people came
sold 15000 of 20000 copies
article 7b and room 101
lines 30-45 were cut
follow @team for more
born 1867, died 1934
wait (at) the gate
the 8080 port and 443 too
route A66 near km 120
"""


def lines(table):
    for line in table.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\])+)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), pii.KINDS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        yield text + line[at:], spans


def test_held_out_recall():
    rows = list(lines(HELD_OUT))
    found = pii.find_spans(pii.trained_field(), [t for t, _ in rows])
    want = {(i, s) for i, (_, spans) in enumerate(rows) for s in spans}
    got = {(i, s) for i, (_, spans) in enumerate(found) for s in spans}
    base = {(i, s) for i, (spans, _) in enumerate(found) for s in spans}
    recall, precision = len(want & got) / len(want), len(want & got) / len(got)
    print(f"recall {recall:.3f} precision {precision:.3f}; base alone {len(want & base) / len(want):.3f}", [(rows[i][0], s) for i, s in sorted(want ^ got)])
    assert recall >= 0.9 and precision >= 0.9
    assert not set(HELD_OUT.split("\n")) & set(pii.LABELLED.split("\n")) - {""}


def test_table_holds_nothing_of_the_documents(spark):
    """No value of the labelled table stands in the documents."""
    values = {v for _, v in re.findall(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\])+)\]", pii.LABELLED)} | set(re.findall("[0-9a-f]{20,}", pii.LABELLED))
    for sf in ("0.001", "0.01", "0.1"):
        texts = "\n".join(r.text or "" for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("text").collect())
        assert not [v for v in values if v in texts]
