"""Weights of luma and chroma, as multiples of 2**-16."""

LUMA = (19595, 38470, 7471)
TO_CB, TO_CR = (-11056, -21712, 32768), (32768, -27440, -5328)
CR_RED, CB_GREEN, CR_GREEN, CB_BLUE = 91881, 22554, 46802, 116130
