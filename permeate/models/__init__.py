"""permeate.models"""
