"""Archives too small to train a dictionary on."""

import struct

import pytest

from glyphmill.llm import warc


@pytest.mark.parametrize("payloads", [[], [b"x"], [b"<html>a</html>", b"<html>b</html>"]])
def test_dictionary_is_always_embedded(payloads):
    records = [warc.info_record("2024-01-01T00:00:00Z"), *(warc.build_record(str(i), None, p, "00", None, "2024-01-01T00:00:00Z") for i, p in enumerate(payloads))]
    writer = warc.ArchiveWriter()
    for r in records:
        writer.add(r)
    data = writer.finish()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert list(warc.iter_records(data)) == records
