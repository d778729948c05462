"""What several tests of this folder use."""

WORD = r"[^\x20\x09-\x0D]+"


def shown(df):
    return [r.asDict() for r in df.collect()]
