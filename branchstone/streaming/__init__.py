"""branchstone.streaming"""
