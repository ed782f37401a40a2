"""Italian stems: words of the published sample vocabulary."""

import pytest

from glyphmill.functions.stemming import italian

SAMPLE = """abbandonata abbandon; abbandonate abbandon; abbandonati abbandon; abbandonato abbandon; abbandonava abbandon; abbandonerà abbandon;
abbandoneranno abbandon; abbandonerò abbandon; abbandono abband; abbaruffato abbaruff; abbassamento abbass; abbassando abbass; abbassandola abbass;
abbassandole abbass; abbassar abbass; abbassare abbass; abbassarono abbass; abbassarsi abbass; abbassassero abbass; abbassato abbass; abbassava abbass;
abbassi abbass; abbassò abbass; abbastanza abbast; abbatté abbatt; abbattendo abbatt; abbattere abbatt; abbattersi abbatt;
pronta pront; prontamente pront; pronte pront; pronti pront; prontissimo prontissim; pronto pront; prontuario prontuar; pronunce pronunc; pronuncia pronunc;
pronunciò pronunc; pronunzia pronunz; pronunziano pronunz; pronunziare pronunz; pronunziarle pronunz; pronunziato pronunz; pronunzio pronunz; pronunziò pronunz;
propaga propag; propagamento propag; propaganda propagand; propagare propag; propagarla propag; propagarsi propag; propagasse propag; propagata propag;
propagazione propag; propaghino propaghin; propalate propal; propende prop; propensi propens; propensione propension; propini propin; propio prop; propizio propiz"""


@pytest.mark.parametrize("pair", [p.split() for p in SAMPLE.split(";")], ids=lambda p: p[0])
def test_sample(pair):
    assert italian(pair[0]) == pair[1]


def test_short_and_odd_words():
    for word in ("", "è", "ità", "ch", "glielo", "12", "ando" * 50):
        assert isinstance(italian(word), str)
