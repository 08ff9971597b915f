"""Small fixed inputs of the engine."""

from __future__ import annotations

# Cut files, a latitude and a longitude per line. The first line is the point where sections are
# joined; each further line equal to the second starts a cut.
CUTS = {
    "basic": "0 11.5\n-60 -168.5\n-60 0\n-60 -168.5\n90 -168.5\n90 -180\n90 180\n90 11.5\n85 11.5",
    "oceans": "90 0\n-55 80\n-55 -20\n0 -20\n-55 80\n-10 80\n-55 80\n-55 180\n-55 -180\n-55 -100\n-10 -100\n40 -150\n40 -180",
    "example": "90 0\n-60 -20\n-60 80\n-10 80\n-60 -20\n-60 -100\n-10 -100\n40 -150\n40 -180\n-60 -20\n0 -20\n30 -50",
}
# Options files.
OPTIONS = {
    "continents": "number: 1\ncuts: oceans\nshape_weights: land\nscale_weights: land\nsize: inf,inf\nsection_names: America,Africa,Australia",
    "oceans": "number: 2\ncuts: mountains\nshape_weights: sea\nscale_weights: sea\nsize: inf,inf\nsection_names: Indian,Atlantic,Pacific",
    "countries": "number: 3\ncuts: basic\nshape_weights: land\nscale_weights: land_sinATA\nsize: 24_000,14_000\nsection_names: west,east",
    "example": "number: 4\ncuts: example\nshape_weights: land\nscale_weights: land\nsize: inf,inf\nsection_names: Africa,Australia,America",
}
# Straits (lat, lon) that maps show whole, and the distance around them in km.
STRAITS = [(66.5, -168.5), (9.1, -79.7), (30.7, 32.3), (1.8, 102.4), (-10.0, 102.4), (-10.0, 116.0), (-10.0, 129.0), (-60.0, -65.0), (53.2, -168.5), (-3.7, -168.5)]
STRAIT_KM = 1200.0
# Uninhabited islands (lat, lon; two degrees around), deserts (lat, lon, half axes), limits of settlement.
ISLANDS = [
    (-6.0, 72.0), (-54.0, 3.0), (-40.0, -9.0), (-46.0, 38.0), (-53.0, 73.0), (-46.0, 52.0), (15.0, 169.0), (10.0, -109.0), (24.0, 154.0), (19.0, 167.0),
    (1.0, -29.0), (-21.0, -29.0), (-55.0, 159.0), (-38.0, 78.0), (-49.0, 179.0),
]
DESERTS = [(23.0, 8.0, 7.0, 20.0), (-24.0, 132.0, 7.0, 15.0), (90.0, -90.0, 35.0, 50.0)]
NORTH_LIMIT, SOUTH_LIMIT = 78.0, -56.0

# The elevation tiles that the drainage divides are searched on.
ELEVATION_TILES = (
    "gt30w180n90", "gt30w140n40", "gt30w140n90",
    "gt30w100s10", "gt30w100n40", "gt30w020s10",
    "gt30e020s10", "gt30e020n40", "gt30e020n90",
    "gt30e060n40", "gt30e060n90",
    "gt30e100s10", "gt30e100n40", "gt30e100n90",
    "gt30e140s10", "gt30e140n40", "gt30e140n90",
)
