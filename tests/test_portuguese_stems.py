"""Portuguese stems: words of the published sample vocabulary."""

import pytest

from glyphmill.functions.stemming import portuguese

SAMPLE = """boa boa; boainain boainain; boas boas; boataria boat; boate boat; boates boat; boatos boat; bob bob; boba bob; bobagem bobag; bobagens bobagens;
bobalhões bobalhõ; bobear bob; bobeira bobeir; bobinho bobinh; bobinhos bobinh; bobo bob; bobs bobs; boca boc; bocadas boc; bocadinho bocadinh; bocado boc;
bocarra bocarr; bocas boc; bode bod; bodoque bodoqu; body body; boeing boeing; boemia boem; boêmio boêmi; bogotá bogot; boi boi;
quilométricas quilométr; quilométricos quilométr; quilômetro quilômetr; quilômetros quilômetr; química químic; químicas químic; químico químic; quimioterapia quimioterap;
quimioterápicos quimioteráp; quimono quimon; quinhão quinhã; quinhões quinhõ; quinta quint; quintal quintal; quintas quint; quinto quint; quinze quinz; quiosque quiosqu;
quis quis; quisemos quis; quiser quis; quiseram quis; quisesse quis; quisessem quis"""


@pytest.mark.parametrize("pair", [p.split() for p in SAMPLE.split(";")], ids=lambda p: p[0])
def test_sample(pair):
    assert portuguese(pair[0]) == pair[1]


def test_short_and_odd_words():
    for word in ("", "é", "ã", "ir", "eira", "amente", "ç", "12", "ira" * 60):
        assert isinstance(portuguese(word), str)
