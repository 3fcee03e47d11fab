"""Fixed column orders and sentinels of the particle, pair and result tables."""

from __future__ import annotations

# Sentinels (fixed values): -1 = unset, class 0 = unclustered, class -1 = clustering not run,
# particle class -100 = inserted by gap filling, 1.1 = inserted inner particle or edge.
UNSET = -1
UNCLUSTERED = 0
INSERTED_CLASS = -100
INSERTED_COLOUR = "100.00-100.00-100.00"
INSERTED_PSF = "notImplemented.mrc"
NO_COLOUR = "0-0-0"
NO_NEIGHBOUR = "-1:-1"
INNER_FILL = 1.1

PARTICLE_COLUMNS = [
    "particle_id", "tomo_name", "tomo_id", "x", "y", "z", "phi", "psi", "theta", "cls", "psf",
]

VECT = ["pairTransVectX", "pairTransVectY", "pairTransVectZ"]
ANGLE = ["pairTransAngleZXZPhi", "pairTransAngleZXZPsi", "pairTransAngleZXZTheta"]
INV_VECT = ["pairInvTransVectX", "pairInvTransVectY", "pairInvTransVectZ"]
INV_ANGLE = ["pairInvTransAngleZXZPhi", "pairInvTransAngleZXZPsi", "pairInvTransAngleZXZTheta"]
COORD1 = ["pairCoordinateX1", "pairCoordinateY1", "pairCoordinateZ1"]
COORD2 = ["pairCoordinateX2", "pairCoordinateY2", "pairCoordinateZ2"]
EULER1 = ["pairAnglePhi1", "pairAnglePsi1", "pairAngleTheta1"]
EULER2 = ["pairAnglePhi2", "pairAnglePsi2", "pairAngleTheta2"]

# Pair table, 47 columns in file order.
PAIR_COLUMNS = [
    "pairIDX1", "pairIDX2", "pairTomoID",
    *VECT, *ANGLE, *INV_VECT, *INV_ANGLE,
    "pairLenTrans", "pairAngDist",
    *COORD1, *EULER1, "pairClass1", "pairPsf1",
    "pairNeighPlus1", "pairNeighMinus1", "pairPosInPoly1",
    *COORD2, *EULER2, "pairClass2", "pairPsf2",
    "pairNeighPlus2", "pairNeighMinus2", "pairPosInPoly2",
    "pairTomoName", "pairPixelSizeAng", "pairOriPartList", "pairMaxDist",
    "pairClass", "pairClassColour", "pairLabel", "pairScore",
]

# Columns exchanged when a pair changes direction; neighbour lists and chain positions stay.
SWAPPED = [
    ("pairIDX1", "pairIDX2"),
    *zip(VECT, INV_VECT), *zip(ANGLE, INV_ANGLE),
    *zip(COORD1, COORD2), *zip(EULER1, EULER2),
    ("pairClass1", "pairClass2"), ("pairPsf1", "pairPsf2"),
]

CLASS_STAT_COLUMNS = [
    "classNr", "num", "stdTransVect", "stdTransAng", "meanVectDist", "meanAngDist",
    "meanCNDist", "stdCNDist", "minCNDist", "maxCNDist",
    "numPolybg5", "numPolybg3", "numPolyMax", "numBranch", "tomoNrPolyMax", "polyIDMax",
    "meanTransVectX", "meanTransVectY", "meanTransVectZ",
    "meanTransAngPhi", "meanTransAngPsi", "meanTransAngTheta",
]
CHAIN_STAT_COLUMNS = ["num", "tomoNr", "classNr", "polyID", "hasBranch", "confClassVect", "posInListVect"]
END_COLUMNS = [
    "pairTomoName", "pairTomoID", "pairClass", "pairIDX", "ifWoOut", "ifWoIn", "pairLabel", "polylen_riboNr",
]
