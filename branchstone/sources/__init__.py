"""branchstone.sources"""
