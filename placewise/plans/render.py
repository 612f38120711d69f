"""Text sinks for one map: SVG and GeoJSON, built on the driver from a plan's few rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from html import escape


def _project(lon: float, lat: float) -> tuple[float, float]:
    return math.radians(lon), math.log(math.tan(math.pi / 4 + math.radians(max(-89.9, min(89.9, lat))) / 2))


def svg(spec: Mapping, lines: Mapping[str, Iterable[list[tuple[float, float]]]] = (), points: Iterable[Mapping] = (), title: str = "", width: int = 800) -> str:
    """A map of a plan's row: polylines by layer name, and points with lon, lat, and optionally name, halign, valign, hoffset, voffset."""
    x0, y0 = _project(spec["xmin"], spec["ymin"])
    x1, y1 = _project(spec["xmax"], spec["ymax"])
    scale = width / max(1e-12, x1 - x0)
    height = (y1 - y0) * scale

    def at(lon: float, lat: float) -> tuple[float, float]:
        x, y = _project(lon, lat)
        return (x - x0) * scale, height - (y - y0) * scale

    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height:.0f}"><title>{escape(title)}</title>']
    for layer in spec["layers"]:
        dash = ' stroke-dasharray="4"' if layer["linestyle"] == "dash" else ""
        for part in dict(lines).get(layer["name"], ()):
            path = " ".join("{:.1f},{:.1f}".format(*at(*p)) for p in part)
            out.append(f'<polyline fill="none" stroke="{layer["color"]}" stroke-width="{layer["width"]}" stroke-opacity="{layer["alpha"]}"{dash} points="{path}"/>')
    anchors = {"left": "start", "center": "middle", "right": "end"}
    baselines = {"bottom": "auto", "center": "middle", "top": "hanging"}
    for p in points:
        x, y = at(p["lon"], p["lat"])
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"/>')
        if p.get("name"):
            out.append(f'<text x="{x + p.get("hoffset", 0):.1f}" y="{y - p.get("voffset", 0):.1f}" text-anchor="{anchors[p.get("halign", "left")]}" dominant-baseline="{baselines[p.get("valign", "bottom")]}">{escape(p["name"])}</text>')
    return "\n".join([*out, "</svg>"])


def geojson(points: Iterable[Mapping]) -> str:
    """Points as a feature collection; lon and lat become the geometry, all else properties."""
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [p["lon"], p["lat"]]}, "properties": {k: v for k, v in p.items() if k not in ("lon", "lat")}} for p in points]
    return json.dumps({"type": "FeatureCollection", "features": features})
