"""Providers of pages for the tests."""


class Fixed:
    def __init__(self, options):
        self.options = options

    def latest(self):
        return 25

    def pages(self, start, end):
        for i in range(start, end):
            yield i * 3, f"page {i} of those supplied " * 5


class Growing(Fixed):
    """As many pages as a file says."""

    def latest(self):
        with open(self.options["there"]) as f:
            return int(f.read())
