"""Schemas of the data model.  Indices are 0-based; a complex value is a pair of doubles ``re``, ``im``."""

SESSIONS = "session_id string, subject_id string, grp string, visit int, site string"
MOTION = "session_id string, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double"
SIGNAL = "session_id string, hemi string, vertex int, y array<double>"
ANALYTIC = "session_id string, hemi string, vertex int, re array<double>, im array<double>"
OBS = "session_id string, t int, re array<double>, im array<double>"
VOLUME = "session_id string, i int, j int, k int, y array<double>, affine array<double>"
FACES = "hemi string, a int, b int, c int"
ATLAS = "hemi string, vertex int, label string"
LOADINGS = "run int, vertex int, pc int, re double, im double"
SCORES = "run int, session_id string, t int, pc int, re double, im double"
BETAS = "session_id string, vertex int, pc int, re double, im double"
