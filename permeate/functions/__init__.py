"""permeate.functions"""
