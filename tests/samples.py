"""Activity files made for the tests."""

from __future__ import annotations

import struct

GPX = """<?xml version="1.0" encoding="UTF-8"?>
<gpx creator="test" version="1.1" xmlns="http://www.topografix.com/GPX/1/1">
 <metadata><time>{start}</time></metadata>
 <trk><name>Evening loop</name><type>{kind}</type>
 <trkseg>{points}</trkseg><trkseg></trkseg></trk>
 <trk><name>second track is not read</name><trkseg><trkpt lat="1" lon="1"/></trkseg></trk>
</gpx>"""


def gpx(points, kind="ride", start="2025-06-03T07:41:00.250Z") -> bytes:
    p = "".join(f'<trkpt lat="{lat}" lon="{lng}">' + (f"<ele>{e}</ele>" if e is not None else "") + "</trkpt>" for lng, lat, e in points)
    return GPX.format(points=p, kind=kind, start=start).encode()


def tcx(points, lead="    ") -> bytes:
    p = "".join(f"<Trackpoint><Time>{t}</Time>" + (f"<Position><LatitudeDegrees>{lat}</LatitudeDegrees><LongitudeDegrees>{lng}</LongitudeDegrees></Position>" if lng is not None else "") + "</Trackpoint>" for t, lng, lat in points)
    return (lead + f'<?xml version="1.0"?><TrainingCenterDatabase><Activities><Activity Sport="Running"><Id>x</Id><Lap><Track>{p}</Track></Lap></Activity></Activities></TrainingCenterDatabase>').encode()


def fit(points, start=1_000_000_000, sub_sport=7, chained=False) -> bytes:
    """A FIT stream with file_id, records and a session; points are lng, lat, altitude (m), seconds."""

    def define(local, number, fields):
        return bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields)) + b"".join(bytes(f) for f in fields)

    body = define(0, 0, [(0, 1, 0), (1, 2, 0x84)]) + bytes([0]) + struct.pack("<BH", 4, 1)
    body += define(1, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84)])
    for lng, lat, ele, t in points:
        body += bytes([1]) + struct.pack("<IiiH", start + t, round(lat * 2**32 / 360), round(lng * 2**32 / 360), int((ele + 500) * 5))
    body += define(2, 18, [(2, 4, 0x86), (6, 1, 0), (11, 2, 0x84)]) + bytes([2]) + struct.pack("<IBH", start, sub_sport, 1188)
    one = struct.pack("<BBHI4sH", 14, 0x10, 2132, len(body), b".FIT", 0) + body + b"\0\0"
    return one * (2 if chained else 1)


RIDE = [(13.402 + 0.00021 * i, 52.5021 + 0.00007 * (i * i % 5), 61.5 + (3 * i % 4) / 10) for i in range(9)]
RUN = [("2026-04-15T06:12:07Z", 9.1832, 48.7761), ("2026-04-15T06:13:40Z", 9.1841, 48.7758), ("2026-04-15T06:14:02Z", None, None), ("2026-04-15T06:18:31Z", 9.1856, 48.7749)]
LOOP = [(13.3 + i * 0.0004, 52.5 + (i % 7) * 0.0003, 40 + i % 9, 10 * i) for i in range(60)]


def pulled(since):
    """A client that finds nothing."""
    return []


def write_folder(path) -> None:
    import gzip

    (path / "virtual").mkdir(parents=True)
    (path / "sample.gpx").write_bytes(gpx(RIDE))
    (path / "sample.tcx").write_bytes(tcx(RUN))
    (path / "sample.fit.gz").write_bytes(gzip.compress(fit(LOOP)))
    (path / "empty.tcx").write_bytes(tcx([("2026-01-02T10:00:00Z", None, None)]))
    (path / "corrupted.gpx").write_bytes(gpx(RIDE)[:400])
    (path / "bad.fit.gz").write_bytes(b"no gzip")
    (path / "virtual" / "v.gpx").write_bytes(gpx(RIDE, "VirtualRide"))
    (path / "virtual" / "v.fit").write_bytes(fit(LOOP, sub_sport=58))
    (path / "notes.txt").write_text("no activity")
