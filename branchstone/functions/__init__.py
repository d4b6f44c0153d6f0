"""branchstone.functions"""
